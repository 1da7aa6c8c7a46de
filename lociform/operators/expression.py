"""Differential results, pseudobulk, enrichment and activity scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import ordered_rank


def significant(p: str = "padj", lfc: str = "log2FoldChange", p_cut: float = 0.05, lfc_cut: float = 1.0, p_closed: bool = True, lfc_closed: bool = True) -> Column:
    """Whether a result passes; the bounds belong to it or not as told, NULLs do not pass."""
    a = F.col(p) <= p_cut if p_closed else F.col(p) < p_cut
    b = F.abs(lfc) >= lfc_cut if lfc_closed else F.abs(lfc) > lfc_cut
    return F.coalesce(a & b, F.lit(False))


def select(results: DataFrame, how: str = "union", **cuts) -> DataFrame:
    """Features significant in any (union) or every (intersect) comparison."""
    hits = results.where(significant(**cuts)).groupBy("feature_id").agg(F.countDistinct("comparison").alias("n_comparisons"))
    if how == "union":
        return hits
    n = results.agg(F.countDistinct("comparison").alias("__n"))
    return hits.crossJoin(F.broadcast(n)).where("n_comparisons = __n").drop("__n")


def comparison_table(results: DataFrame, comparisons: list[str], p: str = "padj", p_cut: float = 0.05, lfc_cut: float = 0.0, needs_hits: bool = True) -> DataFrame:
    """One row per feature that is significant (p < p_cut, |lfc| >= lfc_cut) in a listed comparison, with its lfc and padj in each,
    NULL where it was not tested. It is an error if no feature is significant, unless `needs_hits` is off: then the table is empty."""
    r = results.where(F.col("comparison").isin(comparisons))
    hits = r.where(significant(p=p, p_cut=p_cut, lfc_cut=lfc_cut, p_closed=False)).select("feature_id").distinct()
    if needs_hits and hits.isEmpty():
        raise ValueError(f"no feature is significant ({p} < {p_cut}, |log2 fold change| >= {lfc_cut}) in any comparison")
    results = r.join(hits, "feature_id", "left_semi")
    pick = lambda c, column: F.max(F.when(F.col("comparison") == c, F.col(column)))
    cols = [pick(c, k).alias(f"{c}_{n}") for c in comparisons for k, n in (("log2FoldChange", "lfc"), ("padj", "padj"))]
    return results.groupBy("feature_id").agg(*cols)


def direction_counts(results: DataFrame, **cuts) -> DataFrame:
    up = significant(**cuts) & (F.col("log2FoldChange") > 0)
    down = significant(**cuts) & (F.col("log2FoldChange") < 0)
    return results.groupBy("comparison").agg(F.count_if(up).alias("n_up"), F.count_if(down).alias("n_down"), F.avg("log2FoldChange").alias("mean_lfc"), F.percentile("log2FoldChange", 0.5).alias("median_lfc"))


def group_shift(values: DataFrame, samples: DataFrame, a: str, b: str, pseudo: float = 1.0) -> DataFrame:
    """Per feature the group means and log2((mean_b + pseudo) / (mean_a + pseudo))."""
    v = values.join(samples.select("sample_id", "grp"), "sample_id")
    g = v.groupBy("feature_id").agg(F.avg(F.when(F.col("grp") == a, F.col("value"))).alias("mean_a"), F.avg(F.when(F.col("grp") == b, F.col("value"))).alias("mean_b"))
    return g.withColumn("log2FoldChange", F.log2((F.col("mean_b") + pseudo) / (F.col("mean_a") + pseudo)))


def pseudobulk(expr: DataFrame, cells: DataFrame, min_cells: int = 10, min_samples: int = 2) -> DataFrame:
    """Summed counts per cluster, sample and gene; cluster samples with too few cells drop, then clusters with too few samples."""
    n = cells.groupBy("cluster", "sample_id").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= min_cells)
    n = n.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("cluster"))).where(F.col("k") >= min_samples).drop("k")
    x = expr.join(cells.select("cell", "cluster", "sample_id"), "cell").join(n, ["cluster", "sample_id"])
    return x.groupBy("cluster", "sample_id", "gene").agg(F.sum("counts").cast("bigint").alias("counts"), F.max("n_cells").alias("n_cells"))


def over_representation(sets: DataFrame, hits: DataFrame, universe: DataFrame, least: int = 1, most: int = 10_000) -> DataFrame:
    """Overlap table of gene sets with the hits in a universe: set_id, set_size, overlap, n_hits, n_universe, odds_ratio."""
    s = sets.distinct().join(universe.distinct(), "gene", "left_semi")
    h = hits.distinct().join(universe.distinct(), "gene", "left_semi").withColumn("hit", F.lit(1))
    g = s.join(h, "gene", "left").groupBy("set_id").agg(F.count(F.lit(1)).alias("set_size"), F.count("hit").alias("overlap"))
    g = g.where(F.col("set_size").between(least, most))
    total = h.agg(F.count(F.lit(1)).alias("n_hits")).crossJoin(universe.agg(F.countDistinct("gene").alias("n_universe")))
    g = g.crossJoin(F.broadcast(total))
    a, b, c = F.col("overlap"), F.col("set_size") - F.col("overlap"), F.col("n_hits") - F.col("overlap")
    d = F.col("n_universe") - F.col("set_size") - c
    return g.withColumn("odds_ratio", a * d / (b * c + 1e-10))


def gsea(ranked: DataFrame, sets: DataFrame, least: int = 1, most: int = 10_000, by: list[str] | None = None) -> DataFrame:
    """Running-sum enrichment score (weight 1) of each set over a ranked list (gene, stat), or one such list per `by`.

    The extremes lie at a set's own genes, right at or right before them, so only those rows are visited: the misses
    before a gene follow from its rank.
    """
    by = by or []
    r = ranked.where("stat IS NOT NULL").groupBy(*by, "gene").agg(F.max("stat").alias("stat"))
    r = ordered_rank(r, by, "stat", "gene")
    m = sets.distinct().join(r, "gene")
    w = Window.partitionBy(*by, "set_id")
    m = m.withColumns({"size": F.count(F.lit(1)).over(w), "norm": F.sum(F.abs("stat")).over(w), "hit": F.sum(F.abs("stat")).over(w.orderBy("rank")), "k": F.row_number().over(w.orderBy("rank"))})
    m = m.where(F.col("size").between(least, most))
    miss = F.try_divide(F.col("rank") - F.col("k"), (F.col("n") - F.col("size")).cast("double"))
    miss = F.coalesce(miss, F.lit(0.0))
    top = F.try_divide(F.col("hit"), F.col("norm")) - miss
    low = F.try_divide(F.col("hit") - F.abs("stat"), F.col("norm")) - miss
    g = m.groupBy(*by, "set_id").agg(F.max("size").alias("size"), F.max(top).alias("hi"), F.min(low).alias("lo"))
    return g.select(*by, "set_id", "size", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))


def set_similarity(sets: DataFrame) -> DataFrame:
    """Jaccard overlap of every pair of sets that share a gene."""
    s = sets.distinct()
    size = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    p = s.alias("a").join(s.alias("b"), (F.col("a.gene") == F.col("b.gene")) & (F.col("a.set_id") < F.col("b.set_id"))).groupBy(F.col("a.set_id").alias("x"), F.col("b.set_id").alias("y")).agg(F.count(F.lit(1)).alias("shared"))
    p = p.join(size.select(F.col("set_id").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("set_id").alias("y"), F.col("n").alias("ny")), "y")
    return p.select("x", "y", "shared", (F.col("shared") / (F.col("nx") + F.col("ny") - F.col("shared"))).alias("jaccard"))


def activity(values: DataFrame, network: DataFrame, method: str = "wsum", least: int = 5) -> DataFrame:
    """Activity of each source per sample from its targets (source, target, mor): wsum, wmean or ulm (slope t)."""
    j = values.join(network, values.feature_id == network.target)
    if method in ("wsum", "wmean"):
        g = j.groupBy("source", "sample_id").agg(F.count(F.lit(1)).alias("n_targets"), F.sum(F.col("value") * F.col("mor")).alias("s"), F.sum(F.abs("mor")).alias("m"))
        score = F.col("s") if method == "wsum" else F.try_divide(F.col("s"), F.col("m"))
        return g.where(F.col("n_targets") >= least).select("source", "sample_id", "n_targets", score.alias("score"))
    # univariate linear model over all features of the sample, the weight of non-targets being 0: moments suffice
    per = values.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sy"), F.sum(F.col("value") * F.col("value")).alias("syy"))
    g = j.groupBy("source", "sample_id").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("mor").alias("sx"), F.sum(F.col("mor") * F.col("mor")).alias("sxx"), F.sum(F.col("mor") * F.col("value")).alias("sxy"))
    x = g.where(F.col("n_targets") >= least).join(per, "sample_id")
    cxx, cyy, cxy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    r = F.try_divide(cxy, F.sqrt(cxx * cyy))
    t = r * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - r * r))
    return x.select("source", "sample_id", "n_targets", t.alias("score"))


def annotation_counts(peaks: DataFrame) -> DataFrame:
    """(sample_id, peak_id, annotation): counts and shares of every annotation in every sample, zeros kept."""
    grid = peaks.select("sample_id").distinct().crossJoin(F.broadcast(peaks.where("annotation IS NOT NULL").select("annotation").distinct()))
    c = peaks.groupBy("sample_id", "annotation").agg(F.count(F.lit(1)).alias("n"))
    x = grid.join(c, ["sample_id", "annotation"], "left").na.fill(0, ["n"])
    return x.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("sample_id"))))


def directions(results: DataFrame, by: str, lfc_cut: float = 0.0, p_cut: float = 0.05, least: int = 3) -> DataFrame:
    """(by, direction, gene): significant genes up (lfc above the cut) and down (below its negative), lists of fewer than `least` left out."""
    sig = results.where(F.col("padj") < p_cut)
    up, down = F.col("log2FoldChange") > lfc_cut, F.col("log2FoldChange") < -lfc_cut
    x = sig.where(up | down).select(by, F.when(up, "up").otherwise("down").alias("direction"), F.col("feature_id").alias("gene")).distinct()
    n = x.groupBy(by, "direction").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return x.join(n, [by, "direction"]).drop("__n")


def over_representation_by(lists: DataFrame, sets: DataFrame, universe: DataFrame, by: list[str], least: int = 1, most: int = 10_000) -> DataFrame:
    """over_representation() for each list of (by..., gene), against the genes tested in it: `universe` has the first of `by` and gene."""
    u = universe.distinct()
    key = by[0]
    s = sets.distinct().join(u, "gene")
    size = s.groupBy(key, "set_id").agg(F.count(F.lit(1)).alias("set_size")).where(F.col("set_size").between(least, most))
    h = lists.join(u, [key, "gene"], "left_semi")
    hits = h.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hits"))
    over = h.join(s, [key, "gene"]).groupBy(*by, "set_id").agg(F.count(F.lit(1)).alias("overlap"))
    total = u.groupBy(key).agg(F.count(F.lit(1)).alias("n_universe"))
    x = hits.join(size, key).join(total, key).join(over, [*by, "set_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    a, b, c = F.col("overlap"), F.col("set_size") - F.col("overlap"), F.col("n_hits") - F.col("overlap")
    d = F.col("n_universe") - F.col("set_size") - c
    return x.withColumn("odds_ratio", a * d / (b * c + 1e-10))


def gsea_by(ranked: DataFrame, sets: DataFrame, by: str, min_ranked: int = 10, **how) -> DataFrame:
    """gsea() per `by`; lists with fewer than `min_ranked` genes give one row without a set."""
    n = ranked.where("stat IS NOT NULL").groupBy(by).agg(F.countDistinct("gene").alias("n_ranked"))
    every = ranked.select(by).distinct().join(n, by, "left").withColumn("n_ranked", F.coalesce("n_ranked", F.lit(0)))
    fit = ranked.join(every.where(F.col("n_ranked") >= min_ranked), by)
    got = gsea(fit.select(by, "gene", "stat"), sets, by=[by], **how)
    skipped = every.where(F.col("n_ranked") < min_ranked).select(by, F.lit(None).cast("string").alias("set_id"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("es"))
    return got.unionByName(skipped).join(every, by)


def mean_by_level(expr: DataFrame, cells: DataFrame, level: str) -> DataFrame:
    """Mean expression of each gene over all cells of each level, as one JSON object per gene with the levels in order."""
    n = cells.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    s = expr.join(cells.select("cell", F.col(level).alias("level")), "cell").where("level IS NOT NULL").groupBy("gene", "level").agg(F.sum("logcounts").alias("s"))
    full = expr.select("gene").distinct().crossJoin(F.broadcast(n)).join(s, ["gene", "level"], "left")
    m = full.select("gene", "level", F.bround(F.coalesce("s", F.lit(0.0)) / F.col("n"), 4).alias("mean"))
    g = m.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("level", "mean"))).alias("means"))
    return g.select("gene", F.to_json(F.map_from_entries("means")).alias("means"))
