"""Operators on long value tables (feature_id, sample_id, value): filters, replicates, scaling, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combine(values: DataFrame, how: str = "outer") -> DataFrame:
    """outer: features missing in a sample count 0 there; inner: only features that every sample has."""
    if how == "inner":
        n = values.agg(F.countDistinct("sample_id").alias("__n"))
        per = values.groupBy("feature_id").agg(F.countDistinct("sample_id").alias("__k"))
        ok = per.crossJoin(F.broadcast(n)).where("__k = __n").select("feature_id")
        return values.join(ok, "feature_id", "left_semi")
    grid = values.select("feature_id").distinct().crossJoin(F.broadcast(values.select("sample_id").distinct()))
    return grid.join(values, ["feature_id", "sample_id"], "left").na.fill(0, ["value"])


def filter_low(values: DataFrame, min_value: float, min_samples: int) -> DataFrame:
    ok = values.groupBy("feature_id").agg(F.count_if(F.col("value") >= min_value).alias("k")).where(F.col("k") >= min_samples)
    return values.join(ok, "feature_id", "left_semi")


def filter_samples(values: DataFrame, samples: DataFrame, **allowed: list) -> DataFrame:
    """Values of the samples whose metadata are among the allowed ones."""
    s = samples
    for column, vs in allowed.items():
        if column not in samples.columns:
            raise ValueError(f"no column {column} in the sample table")
        s = s.where(F.col(column).isin(vs))
    return values.join(s.select("sample_id"), "sample_id", "left_semi")


def match_samples(*views: DataFrame) -> DataFrame:
    """Sample ids present in every view."""
    out = views[0].select("sample_id").distinct()
    for v in views[1:]:
        out = out.intersect(v.select("sample_id").distinct())
    return out


def average_replicates(values: DataFrame, samples: DataFrame, by: list[str], how: str = "mean") -> DataFrame:
    agg = F.avg("value") if how == "mean" else F.percentile("value", 0.5)
    v = values.join(samples.select("sample_id", *by), "sample_id")
    return v.groupBy("feature_id", *by).agg(agg.alias("value"), F.count(F.lit(1)).alias("n_replicates"))


def variance(values: DataFrame) -> DataFrame:
    return values.groupBy("feature_id").agg(F.var_samp("value").alias("variance"))


def by_variance(values: DataFrame, above: float | None = None, top: int | None = None, drop_share: float | None = None) -> DataFrame:
    """Features with variance > above, the `top` most variable, or all but the `drop_share` least variable."""
    v = variance(values)
    if above is not None:
        v = v.where(F.col("variance") > above)
    if drop_share is not None:
        cut = v.agg(F.percentile("variance", drop_share).alias("__cut"))
        v = v.crossJoin(F.broadcast(cut)).where("variance > __cut").drop("__cut")
    if top is not None:
        v = v.orderBy(F.col("variance").desc_nulls_last(), "feature_id").limit(top)
    return v


def shared_variance(views: DataFrame, above: float) -> DataFrame:
    """Features whose variance passes in every view of (view, feature_id, sample_id, value)."""
    v = views.groupBy("view", "feature_id").agg(F.var_samp("value").alias("variance"))
    n = views.agg(F.countDistinct("view").alias("__n"))
    ok = v.where(F.col("variance") > above).groupBy("feature_id").agg(F.count(F.lit(1)).alias("k"))
    return ok.crossJoin(F.broadcast(n)).where("k = __n").select("feature_id")


def pairwise_identical(values: DataFrame, tolerance: float) -> DataFrame:
    """Features with two samples that differ by at most `tolerance`: the smallest gap is between sorted neighbours."""
    w = Window.partitionBy("feature_id").orderBy("value", "sample_id")
    gap = F.lead("value").over(w) - F.col("value")
    return values.where("value IS NOT NULL").withColumn("gap", gap).groupBy("feature_id").agg(F.min("gap").alias("least_gap")).where(F.col("least_gap") <= tolerance)


def scale(values: DataFrame, how: str = "zscore") -> DataFrame:
    """Per feature: zscore, minmax or robust; constant features give NULL.

    robust takes the median and the interquartile range, where that is 0 the MAD (constant 1.4826), where that is 0 too 1; a
    feature of one value, or of no variance, becomes 0.
    """
    g = values.groupBy("feature_id")
    if how == "zscore":
        s = g.agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__d"))
    elif how == "minmax":
        s = g.agg(F.min("value").alias("__m"), (F.max("value") - F.min("value")).alias("__d"))
    else:
        p = F.percentile("value", [0.25, 0.5, 0.75])
        s = g.agg(p.alias("p"), F.var_samp("value").alias("v")).select("feature_id", F.col("p")[1].alias("__m"), (F.col("p")[2] - F.col("p")[0]).alias("iqr"), "v")
        x = values.join(s, "feature_id")
        d = x.groupBy("feature_id").agg((F.percentile(F.abs(F.col("value") - F.col("__m")), 0.5) * 1.4826).alias("mad"))
        spread = F.when(F.col("iqr") > 0, F.col("iqr")).when(F.col("mad") > 0, F.col("mad")).otherwise(1.0)
        scaled = F.when(F.coalesce("v", F.lit(0.0)) == 0, F.col("value") * 0.0).otherwise((F.col("value") - F.col("__m")) / spread)
        return x.join(d, "feature_id").withColumn("value", scaled).drop("__m", "iqr", "v", "mad")
    out = values.join(s, "feature_id")
    return out.withColumn("value", F.try_divide(F.col("value") - F.col("__m"), F.col("__d"))).drop("__m", "__d")


def library_sizes(values: DataFrame) -> DataFrame:
    return values.groupBy("sample_id").agg(F.sum("value").alias("library_size"), F.count_if(F.col("value") > 0).alias("n_detected"))


def log2_cpm(values: DataFrame, prior: float = 1.0) -> DataFrame:
    out = values.join(library_sizes(values).drop("n_detected"), "sample_id")
    return out.select("feature_id", "sample_id", F.log2(F.col("value") / F.col("library_size") * 1e6 + prior).alias("value"))


def size_factors(values: DataFrame) -> DataFrame:
    """Median of ratios to the feature's geometric mean over features that are positive in every sample."""
    n = values.agg(F.countDistinct("sample_id").alias("__n"))
    pos = values.where("value > 0").groupBy("feature_id").agg(F.avg(F.log("value")).alias("__g"), F.count(F.lit(1)).alias("__k"))
    ref = pos.crossJoin(F.broadcast(n)).where("__k = __n").select("feature_id", "__g")
    r = values.join(ref, "feature_id").groupBy("sample_id").agg(F.percentile(F.log("value") - F.col("__g"), 0.5).alias("m"))
    return r.select("sample_id", F.exp("m").alias("size_factor"))


def normalize(values: DataFrame, factors: DataFrame, column: str = "size_factor") -> DataFrame:
    return values.join(factors, "sample_id").select("feature_id", "sample_id", (F.col("value") / F.col(column)).alias("value"))


def spike_in_factors(spikes: DataFrame, reads: str = "spikein_reads") -> DataFrame:
    """Smallest positive spike-in count over the sample's; NULL where there is none."""
    low = spikes.where(F.col(reads) > 0).agg(F.min(reads).alias("__low"))
    return spikes.crossJoin(F.broadcast(low)).select("sample_id", reads, F.try_divide(F.col("__low"), F.col(reads)).alias("scale_factor"))


def median_centre(values: DataFrame) -> DataFrame:
    """Shift every sample to the mean of the sample medians."""
    m = values.groupBy("sample_id").agg(F.percentile("value", 0.5).alias("__m"))
    centre = m.agg(F.avg("__m").alias("__c"))
    out = values.join(m.crossJoin(F.broadcast(centre)), "sample_id")
    return out.select("feature_id", "sample_id", (F.col("value") - F.col("__m") + F.col("__c")).alias("value"))


def to_genes(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """Transcript values summed by gene; versions are stripped on both sides, unmapped transcripts drop."""
    from ..functions.scalar import strip_version

    m = mapping.select(strip_version(F.col("transcript_id")).alias("t"), strip_version(F.col("gene_id")).alias("gene_id")).distinct()
    v = values.withColumn("t", strip_version(F.col("feature_id")))
    return v.join(m, "t").groupBy("gene_id", "sample_id").agg(F.sum("value").alias("value"))


def missing_share(values: DataFrame, by: str) -> DataFrame:
    return values.groupBy(by).agg(F.avg(F.col("value").isNull().cast("int")).alias("missing"), F.count(F.lit(1)).alias("n"))


def drop_missing(values: DataFrame, by: str, most: float) -> DataFrame:
    return values.join(missing_share(values, by).where(F.col("missing") <= most).select(by), by, "left_semi")


def impute(values: DataFrame, how: str = "median", shift: float = 1.8, width: float = 0.3) -> DataFrame:
    """NULLs by the feature's median, its minimum, half its minimum, or (shifted) a value below the sample's range
    that a hash of the cell fixes, so that the result does not depend on the partitioning."""
    w = {"median": F.percentile("value", 0.5), "min": F.min("value"), "half_min": F.min("value") / 2}
    if how in w:
        fill = values.groupBy("feature_id").agg(w[how].alias("__f"))
        return values.join(fill, "feature_id").withColumn("value", F.coalesce("value", "__f")).drop("__f")
    s = values.groupBy("sample_id").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__d"))
    unit = lambda seed: (F.pmod(F.xxhash64("feature_id", "sample_id", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    z = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))
    return values.join(s, "sample_id").withColumn("value", F.coalesce("value", F.col("__m") - shift * F.col("__d") + z * width * F.col("__d"))).drop("__m", "__d")


def wide(values: DataFrame, samples: list[str], agg: Column | None = None) -> DataFrame:
    """One column per listed sample (an explicit list keeps the pivot to one pass)."""
    return values.groupBy("feature_id").pivot("sample_id", samples).agg(agg if agg is not None else F.first("value"))


def long(table: DataFrame, key: str, columns: list[str], name: str = "sample_id", value: str = "value") -> DataFrame:
    return table.unpivot(key, columns, name, value)


def intensities(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide intensities to long log2 values; zero and below is missing."""
    x = long(table, key, columns)
    return x.withColumn("value", F.when(F.col("value") > 0, F.log2("value")))
