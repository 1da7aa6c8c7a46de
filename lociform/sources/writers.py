"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, force: bool = False) -> None:
    """CSV with a header; an existing result stays unless forced."""
    df.write.mode("overwrite" if force else "ignore").option("header", True).csv(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None, force: bool = False) -> None:
    """Parquet, optionally partitioned; intervals are best sorted by chr and start before, for row-group pruning."""
    w = df.write.mode("overwrite" if force else "ignore")
    (w.partitionBy(*by) if by else w).parquet(path)


def intervals(df: DataFrame, path: str, force: bool = False) -> None:
    parquet(df.repartitionByRange("chr", "start").sortWithinPartitions("chr", "start"), path, force=force)


def bed(df: DataFrame, path: str, force: bool = False) -> None:
    cols = [c for c in ("chr", "start", "stop", "name", "score", "strand") if c in df.columns]
    df.select(*cols).repartitionByRange("chr", "start").sortWithinPartitions("chr", "start").write.mode("overwrite" if force else "ignore").option("sep", "\t").csv(path)


def bed_graph(steps: DataFrame, path: str, force: bool = False) -> None:
    """Coverage steps without empty stretches."""
    steps.where("score <> 0").select("chr", "start", "stop", "score").write.mode("overwrite" if force else "ignore").option("sep", "\t").csv(path)


def json_rows(df: DataFrame, path: str, force: bool = False) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite" if force else "ignore").text(path)


#: Rows a file of a written result may hold: one task reads a file whole, since texts may hold line breaks.
RESULT_ROWS_A_FILE = 1_000_000


def result_set(df: DataFrame, folder: str, by: list[str], p: str = "padj", p_cut: float = 0.05, lfc_cut: float = 1.0, force: bool = False) -> None:
    """A differential result as four tables by group: all rows, the significant ones, and these up and down; and their counts.
    `columns` holds the names alone (those of the groups last), since a table without rows has no file that tells them.
    The result is computed once (kept in memory and on disk meanwhile), so that the tables agree. Texts are written as they are,
    line breaks and outer spaces included."""
    hit = F.coalesce((F.col(p) < p_cut) & (F.abs("log2FoldChange") >= lfc_cut), F.lit(False))
    flags = {"_hit": hit, "_up": hit & (F.col("log2FoldChange") > 0), "_down": hit & (F.col("log2FoldChange") < 0)}
    mode, exact = "overwrite" if force else "ignore", {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxRecordsPerFile": RESULT_ROWS_A_FILE}
    kept = df.withColumns(flags).persist()  # flags and not bounds pick kept rows: what is kept is pruned by ranges that leave NaN out
    try:
        for name, flag in (("all", None), ("significant", "_hit"), ("up", "_up"), ("down", "_down")):
            x = kept if flag is None else kept.where(flag)
            x.select(*df.columns).write.mode(mode).option("header", True).options(**exact).partitionBy(*by).csv(f"{folder}/{name}")
        n = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tested"), F.count_if("_hit").alias("n_significant"), F.count_if("_up").alias("n_up"), F.count_if("_down").alias("n_down"))
        csv(n, f"{folder}/summary", force)
    finally:
        kept.unpersist()
    csv(df.select(*[c for c in df.columns if c not in by], *by).limit(0), f"{folder}/columns", force)


def tables(frames: dict[str, DataFrame], folder: str, by: dict[str, list[str]] | None = None, force: bool = False) -> None:
    """A bundle of result tables, each under its name as Parquet, some of them by groups."""
    for name, df in frames.items():
        parquet(df, f"{folder}/{name}", (by or {}).get(name), force)


def triplets(expr: DataFrame, folder: str, force: bool = False) -> None:
    """(gene, cell, counts) as 1-based triplets with the names of genes and cells in order. Names are numbered in one task, being as
    few as the matrix is wide and high; the values are joined to their numbers."""
    from pyspark.sql import Window

    mode = "overwrite" if force else "ignore"
    numbered = {}
    for c in ("gene", "cell"):
        t = expr.select(c).distinct().withColumn(f"{c}_no", F.row_number().over(Window.orderBy(c)))
        t.select(f"{c}_no", c).orderBy(f"{c}_no").coalesce(1).write.mode(mode).option("sep", "\t").csv(f"{folder}/{c}s")
        numbered[c] = t
    x = expr.where("counts <> 0").join(numbered["gene"], "gene").join(numbered["cell"], "cell")
    x.select("gene_no", "cell_no", "counts").write.mode(mode).option("sep", " ").csv(f"{folder}/matrix")
