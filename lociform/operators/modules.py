"""Clusters and network modules: gene lists, overlaps, selections, and sample outliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import strip_version

#: Names of the cluster of what belongs to none (fixed values).
UNASSIGNED = ["grey", "module_0", "C0"]


def cluster_genes(modules: DataFrame, wanted: list[str] | None = None, exclude: list[str] | None = None, strip: bool = False) -> DataFrame:
    """(module, genes, n): distinct genes of each module in order, without the unassigned."""
    x = modules.where(~F.col("module").isin(UNASSIGNED if exclude is None else exclude))
    x = x if wanted is None else x.where(F.col("module").isin(wanted))
    gene = strip_version(F.col("gene")) if strip else F.col("gene")
    g = x.groupBy("module").agg(F.sort_array(F.collect_set(gene)).alias("genes"))
    return g.withColumn("n", F.size("genes"))


def sizes(clusters: DataFrame, column: str = "cluster") -> DataFrame:
    return clusters.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def selected_variables(coefficients: DataFrame, lam: float) -> DataFrame:
    """(grp, n_variables, n_selected, selected) at one penalty: a group is in if any of its coefficients is not zero."""
    x = coefficients.where(F.col("lambda") == lam)
    return x.groupBy("grp").agg(F.count(F.lit(1)).alias("n_variables"), F.count_if(F.col("coefficient") != 0).alias("n_selected")).withColumn("selected", F.col("n_selected") > 0)


def overlap_genes(clusters: DataFrame, modules: DataFrame, results: DataFrame, strip: bool = True) -> DataFrame:
    """All genes of the clusters (gene, cluster) with their module, looked up without versions, and log2FoldChange by the id as it is."""
    key = (lambda c: strip_version(F.col(c))) if strip else F.col
    m = modules.select(key("gene").alias("__k"), "module").groupBy("__k").agg(F.min("module").alias("module"))
    x = clusters.withColumn("__k", key("gene")).join(m, "__k", "left").drop("__k")
    return x.join(results.select(F.col("feature_id").alias("gene"), "log2FoldChange"), "gene", "left")


def overlap_counts(genes: DataFrame) -> DataFrame:
    """Genes per cluster and module."""
    return genes.where("module IS NOT NULL").groupBy("cluster", "module").agg(F.count(F.lit(1)).alias("n"))


def select_modules(table: DataFrame, overlaps: DataFrame, min_cor: float = 0.3, significant: bool = True, min_size: int = 30, min_overlap: int = 1, enriched: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Modules (module, size, cor, sig: the largest absolute trait correlation and whether any is significant) that pass every
    bound; overlap is summed over clusters, and a module without any has 0."""
    o = overlaps.groupBy("module").agg(F.sum("n").alias("overlap"))
    x = table.join(o, "module", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    x = x.where(~F.col("module").isin(["grey", "dummy", "module_0"] if exclude is None else exclude))
    x = x.where((F.col("size") >= min_size) & (F.col("overlap") >= min_overlap) & (F.col("cor") >= min_cor))
    x = x.where("sig") if significant else x
    return x if enriched is None else x.where(F.col("module").isin(enriched))


def pool_modules(genes: DataFrame, selected: DataFrame, name: str = "dummy") -> DataFrame:
    """Genes of modules that are not selected, and of none, go to one module `name`."""
    s = selected.select("module", F.lit(True).alias("__in"))
    x = genes.join(s, "module", "left")
    return x.withColumn("module", F.when(F.col("__in"), F.col("module")).otherwise(F.lit(name))).drop("__in")


def rename(df: DataFrame, names: dict[str, str], column: str = "module") -> DataFrame:
    """Names by a map; what it does not hold becomes NULL."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn(column, F.element_at(F.create_map(*pairs), F.col(column)))


def factor_signature(weights: DataFrame, factor: str, view: str) -> DataFrame:
    return weights.where((F.col("factor") == factor) & (F.col("view") == view)).select("feature", F.col("weight").alias(factor))


def p_triangle(pairs: DataFrame, cut: float = 0.05, hide: bool = True) -> DataFrame:
    """(x, y, p) above the diagonal with p as text; text of p at or above `cut` is empty if hidden."""
    text = F.format_string("%.2e", "p")
    return pairs.where("x < y").withColumn("text", F.when(F.lit(hide) & (F.col("p") >= cut), F.lit("")).otherwise(text))


def ranges_around(best: list[float], width: float = 0.2, bounds: tuple[float, float] = (0.0, 1.0)) -> list[tuple[float, float]]:
    """A range of `width` around each value within the bounds, or the bounds where nothing is left."""
    out = []
    for v in best:
        lo, hi = max(v - width / 2, bounds[0]), min(v + width / 2, bounds[1])
        out.append((lo, hi) if lo < hi else bounds)
    return out


def fine_grid(ranges: list[tuple[float, float]], points: int = 5) -> list[tuple[float, ...]]:
    """All combinations of evenly spaced points of the ranges."""
    import itertools

    if points < 2 or any(a >= b for a, b in ranges):
        raise ValueError("a grid needs at least two points and ranges that are not empty")
    return list(itertools.product(*[[a + (b - a) * k / (points - 1) for k in range(points)] for a, b in ranges]))


def scaled(values: DataFrame) -> DataFrame:
    """Values per feature as z-scores, missing ones being the feature's mean; features that do not vary go."""
    g = values.groupBy("feature_id").agg(F.avg("value").alias("__m"))
    x = values.join(g, "feature_id").withColumn("value", F.coalesce("value", "__m")).drop("__m")
    s = x.groupBy("feature_id").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__d")).where("__d > 0")
    return x.join(s, "feature_id").select("feature_id", "sample_id", ((F.col("value") - F.col("__m")) / F.col("__d")).alias("value"))


def sample_scores(values: DataFrame, k: int = 5) -> DataFrame:
    """(sample_id, component, score): principal components of the samples of z-scored features. The products of all pairs of samples
    are summed in Spark and decomposed on the driver: their number is the square of that of the samples, of which an assay has hundreds."""
    z = scaled(values)
    p = z.alias("a").join(z.alias("b"), "feature_id").groupBy(F.col("a.sample_id").alias("x"), F.col("b.sample_id").alias("y")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("v"))
    rows = p.collect()
    names = sorted({r.x for r in rows})
    at = {s: i for i, s in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    for r in rows:
        gram[at[r.x], at[r.y]] = r.v
    features = z.select("feature_id").distinct().count()
    value, vector = np.linalg.eigh(gram)
    order = np.argsort(-value)[: max(0, min(k, len(names) - 1, features - 1))]
    scores = vector[:, order] * np.sqrt(np.maximum(value[order], 0))
    out = [(s, c + 1, float(scores[i, c])) for s, i in at.items() for c in range(len(order))]
    return values.sparkSession.createDataFrame(out, "sample_id string, component int, score double")


def sample_outliers(values: DataFrame, k: int = 5, threshold: float = 3.0, how: str = "sd") -> DataFrame:
    """(sample_id, distance, outlier): distance from the centre in the first components; an outlier lies at least `threshold` standard
    deviations beyond the mean distance, or MADs (constant 1) beyond the median one."""
    d = sample_scores(values, k).groupBy("sample_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("distance"))
    if how == "sd":
        c = d.agg((F.avg("distance") + threshold * F.stddev_samp("distance")).alias("cut"))
    else:
        m = d.agg(F.percentile("distance", 0.5).alias("m"))
        c = d.crossJoin(F.broadcast(m)).agg((F.max("m") + threshold * F.percentile(F.abs(F.col("distance") - F.col("m")), 0.5)).alias("cut"))
    return d.crossJoin(F.broadcast(c)).select("sample_id", "distance", (F.col("distance") >= F.col("cut")).alias("outlier"))


def simulate_views(spark, samples: int = 100, features: tuple[int, ...] = (500, 1000, 750), signal_samples: int = 25, signal_features: tuple[int, ...] = (50, 50, 40), seed: int = 1234) -> DataFrame:
    """(view, sample, feature, value, signal): independent normal values; the first samples share a shift in the first features of
    every view. Values depend on the cell and the seed, not on the partitioning."""
    unit = lambda k: (F.pmod(F.xxhash64("view", "sample", "feature", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    out = None
    for v, (n, s) in enumerate(zip(features, signal_features, strict=True), 1):
        x = spark.range(samples * n).select(F.lit(v).alias("view"), F.floor(F.col("id") / n).alias("sample"), (F.col("id") % n).alias("feature"), F.lit(s).alias("s"))
        out = x if out is None else out.unionAll(x)
    hit = (F.col("sample") < signal_samples) & (F.col("feature") < F.col("s"))
    z = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * 3.141592653589793 * unit(1))
    return out.select("view", "sample", "feature", (z + F.when(hit, 2.0).otherwise(0.0)).alias("value"), hit.alias("signal"))


def score_markers(pairwise: DataFrame, least: float | None = 0.5, n: int = 10, only: Column | None = None) -> DataFrame:
    """Per cluster the best genes by mean AUC over the other clusters: mean, least, median and largest AUC, mean Cohen's d and mean
    difference of detection; genes below `least` in the mean, or outside of `only`, do not count."""
    g = pairwise.groupBy(F.col("cluster_a").alias("cluster"), "gene").agg(
        F.avg("auc").alias("mean_auc"), F.min("auc").alias("min_auc"), F.percentile("auc", 0.5).alias("median_auc"), F.max("auc").alias("max_auc"),
        F.avg("cohens_d").alias("mean_cohens_d"), F.avg("detected_lfc").alias("mean_detected_lfc"),
    )
    g = g if least is None else g.where(F.col("mean_auc") >= least)
    g = g if only is None else g.where(only)
    w = Window.partitionBy("cluster").orderBy(F.round("mean_auc", 9).desc(), "gene")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
