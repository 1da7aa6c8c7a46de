"""Frames behind plots; nothing is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .expression import significant


def volcano(results: DataFrame, **cuts) -> DataFrame:
    x = results.withColumn("neg_log10_p", -F.log10(F.greatest(F.col(cuts.get("p", "padj")), F.lit(1e-300))))
    hit = significant(**cuts)
    return x.withColumn("class", F.when(hit & (F.col("log2FoldChange") > 0), "up").when(hit, "down").otherwise("none"))


def ma(values: DataFrame) -> DataFrame:
    """mean_a, mean_b to average and difference on the log2 scale."""
    a, b = F.log2(F.col("mean_a") + 1), F.log2(F.col("mean_b") + 1)
    return values.select("feature_id", ((a + b) / 2).alias("average"), (b - a).alias("difference"))


def heatmap(values: DataFrame) -> DataFrame:
    """Row z-scores clipped to +-3."""
    w = Window.partitionBy("feature_id")
    z = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))
    return values.select("feature_id", "sample_id", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)).alias("z"))


def histogram(values: DataFrame, column: str, width: float, by: list[str] | None = None) -> DataFrame:
    b = (F.floor(F.col(column) / width) * width).alias("bin")
    return values.where(F.col(column).isNotNull()).groupBy(*(by or []), b).agg(F.count(F.lit(1)).alias("n"))


def box(values: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    """Five numbers per group, whiskers at the last values within 1.5 interquartile ranges."""
    q = values.groupBy(*by).agg(F.percentile(column, [0.25, 0.5, 0.75]).alias("q"), F.count(column).alias("n")).select(*by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    x = values.join(q, by)
    r = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(column).between(F.col("q1") - r, F.col("q3") + r)
    return x.groupBy(*by, "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"), F.count_if(~inside).alias("n_outliers"))


def scree(explained: DataFrame) -> DataFrame:
    """component, explained to the cumulative share."""
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return explained.select("component", "explained", F.sum("explained").over(w).alias("cumulative"))


def upset(memberships: DataFrame) -> DataFrame:
    """(item, set_id) to counts of exact combinations of sets."""
    m = memberships.groupBy("item").agg(F.array_join(F.sort_array(F.collect_set("set_id")), "&").alias("combination"))
    return m.groupBy("combination").agg(F.count(F.lit(1)).alias("n"))


def sankey(transitions: DataFrame) -> DataFrame:
    return transitions.select(F.concat_ws(":", "step", "from").alias("source"), F.concat_ws(":", F.col("step") + 1, "to").alias("target"), F.col("n").alias("value"))


def enrichment_dots(table: DataFrame, n: int) -> DataFrame:
    w = Window.orderBy("padj", "set_id")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("rank", "set_id", "padj", (F.col("overlap") / F.col("set_size")).alias("gene_ratio"))


def time_course(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean and standard error per feature, group and time point."""
    v = values.join(samples.select("sample_id", "grp", "timepoint"), "sample_id")
    return v.groupBy("feature_id", "grp", "timepoint").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value").cast("double"))).alias("sem"), F.count("value").alias("n"))


def ecdf(values: DataFrame, column: str, by: list[str], steps: int = 100) -> DataFrame:
    """Share of values at or below each of `steps` + 1 even points of [0, 1], per group."""
    b = values.where(F.col(column).isNotNull()).select(*by, F.ceil(F.round(F.col(column) * steps, 9)).cast("int").alias("__k")).groupBy(*by, "__k").agg(F.count(F.lit(1)).alias("n"))
    grid = values.select(*by).distinct().withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = Window.partitionBy(*by)
    x = grid.join(b, [*by, "__k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.select(*by, (F.col("__k") / steps).alias("x"), F.try_divide(F.sum("n").over(w.orderBy("__k")), F.sum("n").over(w)).alias("share"))


def delta_area(curves: DataFrame) -> DataFrame:
    """(k, x, share) of consensus curves to the area under each and its relative gain over the k before (the area itself for the first)."""
    w = Window.partitionBy("k").orderBy("x")
    part = (F.col("x") - F.lag("x").over(w)) * F.col("share")
    a = curves.withColumn("__p", part).groupBy("k").agg(F.sum("__p").alias("area"))
    before = F.lag("area").over(Window.orderBy("k"))  # a row per k
    return a.withColumn("delta", F.when(before.isNull(), F.col("area")).otherwise(F.try_divide(F.col("area") - before, before)))


def waterfall(results: DataFrame, n: int) -> DataFrame:
    """The n strongest results up and down with their place."""
    x = results.where("log2FoldChange <> 0").withColumn("side", F.when(F.col("log2FoldChange") > 0, "up").otherwise("down"))
    w = Window.partitionBy("comparison", "side").orderBy(F.abs("log2FoldChange").desc(), "feature_id")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def joined_scatter(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One point per key of both tables, with the quadrant it lies in."""
    p = a.select(key, F.col(x).alias("x")).join(b.select(key, F.col(y).alias("y")), key)
    return p.withColumn("quadrant", F.concat(F.when(F.col("x") >= 0, "+").otherwise("-"), F.when(F.col("y") >= 0, "+").otherwise("-")))


def shares(counts: DataFrame, by: str, part: str) -> DataFrame:
    """Counts to shares of the whole, largest part first."""
    w = Window.partitionBy(by)
    x = counts.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(w)))
    return x.withColumn("rank", F.row_number().over(w.orderBy(F.col("n").desc(), part)))


def method_agreement(scores: DataFrame) -> DataFrame:
    """Per pair of methods: common (source, sample) scores, their correlation and the share that agrees in sign."""
    a, b = scores.alias("a"), scores.alias("b")
    j = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.method") < F.col("b.method")))
    same = (F.signum("a.score") == F.signum("b.score")).cast("int")
    return j.groupBy(F.col("a.method").alias("x"), F.col("b.method").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.corr("a.score", "b.score").alias("r"), F.avg(same).alias("same_sign"))


def cluster_profiles(values: DataFrame, clusters: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean z-score of each cluster's features per group of samples, with its standard error over features."""
    w = Window.partitionBy("feature_id")
    z = values.withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w)))
    f = z.join(samples.select("sample_id", *by), "sample_id").groupBy("feature_id", *by).agg(F.avg("z").alias("z"))
    g = f.join(clusters, "feature_id").groupBy("cluster", *by)
    return g.agg(F.avg("z").alias("mean"), (F.stddev_samp("z") / F.sqrt(F.count("z").cast("double"))).alias("sem"), F.count("z").alias("n_features"))


def radar(values: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Per group the mean of each variable, scaled to [0, 1] between the groups' smallest and largest mean."""
    m = values.groupBy(by).agg(*[F.avg(c).alias(c) for c in names]).unpivot(by, names, "variable", "mean")
    w = Window.partitionBy("variable")
    return m.withColumn("scaled", F.try_divide(F.col("mean") - F.min("mean").over(w), F.max("mean").over(w) - F.min("mean").over(w)))


def region_track(steps: DataFrame, chr: str, start: int, stop: int) -> DataFrame:
    """Steps of coverage within a region, cut at its ends."""
    x = steps.where((F.col("chr") == chr) & (F.col("start") < stop) & (F.col("stop") > start))
    return x.withColumns({"start": F.greatest(F.col("start"), F.lit(start)), "stop": F.least(F.col("stop"), F.lit(stop))})


def contributions(loadings: DataFrame) -> DataFrame:
    """(component, variable, loading): share of each component that a variable makes up, and its place."""
    w = Window.partitionBy("component")
    x = loadings.withColumn("contribution", F.try_divide(F.col("loading") * F.col("loading"), F.sum(F.col("loading") * F.col("loading")).over(w)))
    return x.withColumn("rank", F.row_number().over(w.orderBy(F.round("contribution", 9).desc(), "variable")))


def top_bars(table: DataFrame, by: list[str], value: str, name: str, n: int, ascending: bool = False) -> DataFrame:
    """The n largest, or smallest, values of each group with their place."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return table.withColumn("rank", F.row_number().over(w.orderBy(order, name))).where(F.col("rank") <= n)


def variance_explained(weights: DataFrame) -> DataFrame:
    """(view, factor, feature, weight): squared weights of a factor as a share of the view's."""
    g = weights.groupBy("view", "factor").agg(F.sum(F.col("weight") * F.col("weight")).alias("s"))
    return g.select("view", "factor", F.try_divide(F.col("s"), F.sum("s").over(Window.partitionBy("view"))).alias("share"))
