"""Single-cell operators over non-zero rows (gene, cell, counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import binned_rank, mad


def cell_metrics(expr: DataFrame, subsets: dict[str, str] | None = None) -> DataFrame:
    """Per cell: sum, detected, log10_genes_per_umi (NULL at one count) and pct_<name> of genes with each prefix."""
    subsets = subsets or {"mito": "MT-"}
    pct = [(F.sum(F.when(F.startswith(F.col("gene"), F.lit(p)), F.col("counts")).otherwise(0)) * 100.0 / F.sum("counts")).alias(f"pct_{n}") for n, p in subsets.items()]
    g = expr.where("counts > 0").groupBy("cell").agg(F.sum("counts").cast("bigint").alias("sum"), F.count(F.lit(1)).alias("detected"), *pct)
    return g.withColumn("log10_genes_per_umi", F.try_divide(F.log10("detected"), F.when(F.col("sum") > 1, F.log10("sum"))))


def _low_high(metrics: DataFrame, value, side: str, k: float):
    """One row (cut): the median less, or plus, k MADs (constant 1.4826)."""
    v = metrics.select(F.lit(1).alias("all"), value.alias("value"))
    sign = -1 if side == "low" else 1
    return mad(v, ["all"]).select((F.col("median") + sign * k * F.col("mad")).alias("cut"))


def filter_adaptive(metrics: DataFrame, share: str | None = "pct_mito", k: float = 3.0, cap: float | None = None, doublet: str | None = None) -> DataFrame:
    """Cells with a column per reason and keep (none holds): low_lib_size and low_n_features (log counts and log detected genes
    more than k MADs below their medians), high_<share> (more than k MADs above), hard_cap and doublets where asked for."""
    x = metrics
    tests = [("low_lib_size", F.log2(F.col("sum")), "low"), ("low_n_features", F.log2(F.col("detected")), "low")]
    if share is not None:
        tests.append((f"high_{share}", F.col(share), "high"))
    for name, value, side in tests:
        cut = _low_high(metrics, value, side, k)
        bad = value < F.col("cut") if side == "low" else value > F.col("cut")
        x = x.crossJoin(F.broadcast(cut)).withColumn(name, F.coalesce(bad, F.lit(False))).drop("cut")
    reasons = [t[0] for t in tests]
    if cap is not None and share is not None:
        x, reasons = x.withColumn("hard_cap", F.coalesce(F.col(share) > cap, F.lit(False))), [*reasons, "hard_cap"]
    if doublet is not None:
        x, reasons = x.withColumn("doublets", F.coalesce(F.col(doublet) == "doublet", F.lit(False))), [*reasons, "doublets"]
    keep = F.lit(True)
    for r in reasons:
        keep = keep & ~F.col(r)
    return x.withColumn("keep", keep)


def filter_reasons(filtered: DataFrame) -> DataFrame:
    """(reason, n): cells that each reason of a filter discards, all of them, and those kept."""
    names = [c for c, t in filtered.dtypes if t == "boolean" and c != "keep"]
    counts = [F.count_if(F.col(c)).alias(c) for c in names] + [F.count_if(~F.col("keep")).alias("discarded"), F.count_if(F.col("keep")).alias("kept")]
    return filtered.agg(*counts).unpivot([], [*names, "discarded", "kept"], "reason", "n")


def filter_fixed(metrics: DataFrame, **bounds: tuple[float | None, float | None]) -> DataFrame:
    keep = F.lit(True)
    for c, (lo, hi) in bounds.items():
        keep = keep & (F.col(c) >= lo if lo is not None else F.lit(True)) & (F.col(c) <= hi if hi is not None else F.lit(True))
    return metrics.withColumn("keep", F.coalesce(keep, F.lit(False)))


def log_normalize(expr: DataFrame) -> DataFrame:
    """logcounts = log2(counts / size factor + 1); a cell's size factor is its total over the mean total of all cells."""
    total = expr.groupBy("cell").agg(F.sum("counts").alias("__t"))
    mean = total.agg(F.avg("__t").alias("__m"))
    return expr.join(total.crossJoin(F.broadcast(mean)), "cell").withColumn("logcounts", F.log2(F.col("counts") * F.col("__m") / F.col("__t") + 1)).drop("__t", "__m")


def variable_genes(expr: DataFrame, n_cells: DataFrame, top: int) -> DataFrame:
    """Most variable genes by variance over mean of the log counts, absent cells counting as zero; n_cells is one row n."""
    g = expr.groupBy("gene").agg(F.sum("logcounts").alias("s"), F.sum(F.col("logcounts") * F.col("logcounts")).alias("q")).crossJoin(F.broadcast(n_cells))
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    x = g.select("gene", mean.alias("mean"), var.alias("variance"), F.try_divide(var, mean).alias("dispersion"))
    return x.orderBy(F.col("dispersion").desc_nulls_last(), "gene").limit(top)


def marker_stats(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Per cluster and gene: mean over all cells of the cluster, and the share of them that expresses it."""
    n = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"))
    g = expr.join(cells.select("cell", "cluster"), "cell").groupBy("cluster", "gene").agg(F.sum("counts").alias("s"), F.count_if(F.col("counts") > 0).alias("k"))
    return g.join(n, "cluster").select("cluster", "gene", (F.col("s") / F.col("n_cells")).alias("mean"), (F.col("k") / F.col("n_cells")).alias("pct"))


def markers(stats: DataFrame, n: int) -> DataFrame:
    """Top genes of each cluster by log2 ratio of its mean to the mean over the other clusters."""
    w = Window.partitionBy("gene")
    k = F.count(F.lit(1)).over(w)
    rest = F.try_divide(F.sum("mean").over(w) - F.col("mean"), k - 1)
    x = stats.withColumn("log2_ratio", F.log2((F.col("mean") + 0.01) / (F.coalesce(rest, F.lit(0.0)) + 0.01)))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("log2_ratio").desc(), "gene"))).where(F.col("rank") <= n)


def label_summary(cells: DataFrame) -> DataFrame:
    """Counts of labels overall, by cluster and by sample, with shares of the group; NULL labels drop."""
    g = cells.where("label IS NOT NULL").groupingSets([["label"], ["cluster", "label"], ["sample_id", "label"]], "label", "cluster", "sample_id").agg(F.count(F.lit(1)).alias("n"), F.grouping("cluster").alias("gc"), F.grouping("sample_id").alias("gs"))
    kind = F.when(F.col("gc") == 0, "cluster").when(F.col("gs") == 0, "sample").otherwise("overall")
    x = g.select(kind.alias("grouping"), F.coalesce(F.when(F.col("gc") == 0, F.col("cluster")), F.when(F.col("gs") == 0, F.col("sample_id")), F.lit("all")).alias("grp"), "label", "n")
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grouping", "grp")))


def type_scores(expr: DataFrame, cells: DataFrame, markers_: DataFrame, most: float = 10.0) -> DataFrame:
    """Cell-type score per cluster: per cell, expression scaled per gene (capped at +-most), summed over up markers less down markers
    and divided by the square root of the markers present; summed over the cluster's cells. markers_: (cell_type, gene, sign).

    Only non-zero rows are read: the cells of a cluster without the gene all have its scaled zero.
    """
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    m = markers_.distinct()
    x = expr.join(m.select("gene").distinct(), "gene", "left_semi")
    g = x.groupBy("gene").agg(F.sum("logcounts").alias("s"), F.sum(F.col("logcounts") * F.col("logcounts")).alias("q")).crossJoin(F.broadcast(n))
    sd = F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    g = g.select("gene", (F.col("s") / F.col("n")).alias("m"), F.greatest(sd, F.lit(2.220446049250313e-16)).alias("d"))
    clip = lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), c))
    size = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"))
    per = x.join(g, "gene").join(cells.select("cell", "cluster"), "cell").groupBy("cluster", "gene").agg(F.sum(clip((F.col("logcounts") - F.col("m")) / F.col("d"))).alias("s"), F.count(F.lit(1)).alias("k"))
    full = size.crossJoin(F.broadcast(g)).join(per, ["cluster", "gene"], "left")
    z = full.select("cluster", "gene", (F.coalesce("s", F.lit(0.0)) + (F.col("n_cells") - F.coalesce("k", F.lit(0))) * clip(-F.col("m") / F.col("d"))).alias("z"))
    t = z.join(m, "gene").groupBy("cluster", "cell_type").agg((F.sum(F.col("z") * F.col("sign")) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("score"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("score", 9).desc(), "cell_type")))


def gene_count_correlation(expr: DataFrame) -> DataFrame:
    """(gene, r): Spearman correlation, over all cells, of a gene's expression with the number of genes a cell expresses.

    Only non-zero rows are read: a gene's zeros share one rank, and the ranks of the gene counts sum to a known total.
    """
    count = expr.where("logcounts > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("detected"))
    y = binned_rank(count, "detected", 1.0, "ry").select("cell", "ry", F.col("n_rows").alias("n"))
    n = F.col("n").cast("double")
    syy = y.agg(F.sum((F.col("ry") - (n + 1) / 2) * (F.col("ry") - (n + 1) / 2)).alias("syy"))
    x = expr.where("logcounts > 0").join(y, "cell")
    w = Window.partitionBy("gene")
    rx = F.rank().over(w.orderBy("logcounts")) + (F.count(F.lit(1)).over(Window.partitionBy("gene", "logcounts")) - 1) / 2.0
    x = x.withColumns({"k": F.count(F.lit(1)).over(w), "rx": rx}).withColumn("rx", F.col("rx") + F.col("n") - F.col("k"))
    mid = (n + 1) / 2
    dx, dy = F.col("rx") - mid, F.col("ry") - mid
    g = x.groupBy("gene").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), F.sum(dy).alias("y"))
    zero = (F.col("n") - F.col("k") + 1) / 2 - mid
    g = g.crossJoin(F.broadcast(syy))
    r = F.try_divide(F.col("xy") - zero * F.col("y"), F.sqrt((F.col("xx") + (F.col("n") - F.col("k")) * zero * zero) * F.col("syy")))
    return g.select("gene", F.coalesce(r, F.lit(0.0)).alias("r"))


def potency(expr: DataFrame, graph: DataFrame, n_genes: int) -> DataFrame:
    """Ordering score in [0, 1]: the mean expression of the genes that correlate most, by absolute value, with the genes a cell
    expresses; averaged over each cell's neighbours in `graph` (cell, other), 0 without any; scaled to its range and inverted."""
    best = gene_count_correlation(expr).select("gene", F.round("r", 9).alias("r")).orderBy(F.abs("r").desc(), "gene").limit(n_genes)
    k = best.agg(F.count(F.lit(1)).alias("k"))
    cells = expr.select("cell").distinct()
    s = expr.join(best.select("gene"), "gene", "left_semi").groupBy("cell").agg(F.sum("logcounts").alias("s"))
    raw = cells.join(s, "cell", "left").crossJoin(F.broadcast(k)).select("cell", (F.coalesce("s", F.lit(0.0)) / F.col("k")).alias("raw"))
    near = graph.join(raw.withColumnRenamed("cell", "other"), "other").groupBy("cell").agg(F.avg("raw").alias("v"))
    x = cells.join(near, "cell", "left").select("cell", F.coalesce("v", F.lit(0.0)).alias("v"))
    ends = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = x.crossJoin(F.broadcast(ends))
    return x.select("cell", F.when(F.col("hi") > F.col("lo"), 1 - (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5).alias("score"))


def composition(cells: DataFrame) -> DataFrame:
    """Share of each cluster in each sample, absent clusters at zero."""
    grid = cells.select("sample_id").distinct().crossJoin(F.broadcast(cells.select("cluster").distinct()))
    c = cells.groupBy("sample_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    x = grid.join(c, ["sample_id", "cluster"], "left").na.fill(0, ["n"])
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample_id")))


def spliced_ratio(splicing: DataFrame) -> DataFrame:
    g = splicing.groupBy("cell").agg(F.sum("spliced").alias("spliced"), F.sum("unspliced").alias("unspliced"))
    return g.withColumn("unspliced_share", F.try_divide(F.col("unspliced"), F.col("spliced") + F.col("unspliced")))


def doublet_rates(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doublet_class") == "doublet").alias("n_doublets")).withColumn("rate", F.col("n_doublets") / F.col("n"))
