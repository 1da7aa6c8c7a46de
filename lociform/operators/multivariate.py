"""Batch effects, time courses, pairwise markers, distances, clustering quality and signal over regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import average_rank
from .intervals import overlap_pairs
from .stats import welch_t


def correct_batch(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Remove batch means within group (the group stays): value - mean(feature, group, batch) + mean(feature, group)."""
    v = values.join(samples.select("sample_id", "grp", "batch"), "sample_id")
    b, g = Window.partitionBy("feature_id", "grp", "batch"), Window.partitionBy("feature_id", "grp")
    return v.select("feature_id", "sample_id", (F.col("value") - F.avg("value").over(b) + F.avg("value").over(g)).alias("value"))


def by_timepoint(values: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Welch test of two groups at each time point (feature_id, timepoint, grp, value)."""
    return welch_t(values, ["feature_id", "timepoint"], a=a, b=b)


def between_timepoints(values: DataFrame, consecutive: bool = True) -> DataFrame:
    """Pairs of time points per feature and group with both means and their difference."""
    m = values.groupBy("feature_id", "grp", "timepoint").agg(F.avg("value").alias("mean"))
    w = Window.partitionBy("feature_id", "grp").orderBy("timepoint")
    if consecutive:
        x = m.withColumns({"next": F.lead("timepoint").over(w), "next_mean": F.lead("mean").over(w)}).where("next IS NOT NULL")
    else:
        n = m.select("feature_id", "grp", F.col("timepoint").alias("next"), F.col("mean").alias("next_mean"))
        x = m.join(n, ["feature_id", "grp"]).where("timepoint < next")
    return x.withColumn("difference", F.col("next_mean") - F.col("mean"))


def pairwise_markers(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """For each gene and ordered cluster pair: AUC, Cohen's d and log2 ratio of detection. expr needs every (cell, gene) of the
    genes asked for, zeros included."""
    x = expr.join(cells.select("cell", "cluster"), "cell")
    c = x.groupBy("gene", "cluster", "value").agg(F.count(F.lit(1)).alias("k"))
    n = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    # distinct values of a gene and cluster meet those of the other cluster: the AUC from counts of smaller and equal
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.gene") == F.col("b.gene")) & (F.col("a.cluster") != F.col("b.cluster")) & (F.col("a.value") >= F.col("b.value")))
    won = F.sum(F.when(F.col("a.value") > F.col("b.value"), F.col("a.k") * F.col("b.k")).otherwise(F.col("a.k") * F.col("b.k") / 2.0))
    auc = j.groupBy(F.col("a.gene").alias("gene"), F.col("a.cluster").alias("cluster_a"), F.col("b.cluster").alias("cluster_b")).agg(won.alias("won"))
    m = x.groupBy("gene", "cluster").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.avg((F.col("value") > 0).cast("int")).alias("d")).join(n, "cluster")
    ma, mb = m.select("gene", *[F.col(k).alias(f"{k}_a") for k in ("cluster", "m", "v", "d", "n")]), m.select("gene", *[F.col(k).alias(f"{k}_b") for k in ("cluster", "m", "v", "d", "n")])
    x = ma.join(mb, "gene").where("cluster_a <> cluster_b").join(auc, ["gene", "cluster_a", "cluster_b"], "left")
    return x.select("gene", "cluster_a", "cluster_b", (F.coalesce("won", F.lit(0.0)) / (F.col("n_a") * F.col("n_b"))).alias("auc"), F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt((F.col("v_a") + F.col("v_b")) / 2)).alias("cohens_d"), F.log2((F.col("d_a") + 0.01) / (F.col("d_b") + 0.01)).alias("detected_lfc"))


def reference_labels(expr: DataFrame, reference: DataFrame) -> DataFrame:
    """Label each cell by its best Spearman correlation with reference profiles (label, gene, value) over shared genes; ties to the smaller label.
    A profile that is constant has no correlation: that label is none, and a cell without any label is left out."""
    j = expr.select("cell", "gene", F.col("value").alias("u")).join(reference.select("label", "gene", F.col("value").alias("v")), "gene")
    r = j.withColumns({"ru": average_rank(["cell", "label"], "u"), "rv": average_rank(["cell", "label"], "v")})
    # corr() itself divides by zero, which is an error in ANSI mode, where all ranks of one side are equal
    varies = (F.min("ru") < F.max("ru")) & (F.min("rv") < F.max("rv"))
    corr = F.try_divide(F.covar_pop("ru", "rv"), F.sqrt(F.var_pop("ru")) * F.sqrt(F.var_pop("rv")))
    g = r.groupBy("cell", "label").agg(F.round(F.when(varies, corr), 9).alias("r")).where("r IS NOT NULL")
    return g.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(F.col("r").desc(), "label"))).where("k = 1").select("cell", "label", "r")


def gower(items: DataFrame, key: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Gower distance of all item pairs (the pairs are the result; callers bound the items)."""
    rng = items.agg(*[(F.max(c) - F.min(c)).cast("double").alias(f"__{c}") for c in numeric])
    a, b = items.alias("a"), items.alias("b")
    p = a.join(b, F.col(f"a.{key}") < F.col(f"b.{key}")).crossJoin(F.broadcast(rng))
    total, weight = F.lit(0.0), F.lit(0)
    for c in numeric + categorical:
        both = F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull()
        d = F.coalesce(F.try_divide(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")), F.col(f"__{c}")), F.lit(0.0)) if c in numeric else (F.col(f"a.{c}") != F.col(f"b.{c}")).cast("double")
        total, weight = total + F.when(both, d).otherwise(0.0), weight + both.cast("int")
    return p.select(F.col(f"a.{key}").alias("x"), F.col(f"b.{key}").alias("y"), F.try_divide(total, weight).alias("distance"))


def within_ss(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Within-cluster sum of squares from moments: no distances are formed."""
    x = points.join(labels, "id").select("cluster", "id", F.posexplode("vec").alias("dim", "v"))
    g = x.groupBy("cluster", "dim").agg((F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v") / F.count(F.lit(1))).alias("ss"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("cluster").agg(F.max("n").alias("n"), F.sum("ss").alias("within_ss"))


def signal_over_regions(steps: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Width-weighted mean signal (chr, start, stop, score) of each region; uncovered bases count 0."""
    p = overlap_pairs(steps, regions)
    g = p.groupBy(F.col(f"b_{key}").alias(key)).agg(F.sum(F.col("overlap_bp") * F.col("score")).alias("__s"))
    return regions.join(g, key, "left").withColumn("signal", F.try_divide(F.coalesce("__s", F.lit(0.0)), (F.col("stop") - F.col("start")).cast("double"))).drop("__s")


def tile_comparison(a: DataFrame, b: DataFrame, pseudo: float = 1.0, least: float = 0.0) -> DataFrame:
    """Binned signals (chr, start, stop, score) of two groups: log2 ratio where either reaches `least`."""
    x = a.select("chr", "start", "stop", F.col("score").alias("a")).join(b.select("chr", "start", "stop", F.col("score").alias("b")), ["chr", "start", "stop"], "full").na.fill(0.0, ["a", "b"])
    return x.where(F.greatest("a", "b") >= least).withColumn("log2_ratio", F.log2((F.col("b") + pseudo) / (F.col("a") + pseudo)))


def enrichment_over_flanks(profile: DataFrame, n_flank: int) -> DataFrame:
    """Per-bin ratio of a profile (bin, n) to the mean of the outermost `n_flank` bins on either side."""
    ends = profile.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    x = profile.crossJoin(F.broadcast(ends))
    back = x.agg(F.avg(F.when((F.col("bin") < F.col("lo") + n_flank) | (F.col("bin") > F.col("hi") - n_flank), F.col("n"))).alias("back"))
    return profile.crossJoin(F.broadcast(back)).select("bin", "n", F.try_divide(F.col("n"), F.col("back")).alias("enrichment"))


def dummy_code(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Indicator columns for all levels but the first; NULL stays NULL."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(column).isNotNull(), (F.col(column) == v).cast("int")) for v in levels[1:]})


def logit_shares(composition: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """Logit of smoothed cluster shares per sample (n, per sample_id and cluster)."""
    w = Window.partitionBy("sample_id")
    p = (F.col("n") + pseudo) / (F.sum("n").over(w) + pseudo * F.count(F.lit(1)).over(w))
    return composition.withColumn("logit", F.log(p / (1 - p)))


def adjacency_power(corr: DataFrame, power: float) -> DataFrame:
    """Soft-threshold connectivity of variables from pair correlations (x, y, r): sum of |r|^power."""
    both = corr.select(F.col("x").alias("v"), "r").unionAll(corr.select("y", "r"))
    return both.groupBy("v").agg(F.sum(F.pow(F.abs("r"), F.lit(power))).alias("connectivity"))
