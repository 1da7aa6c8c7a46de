"""A stream of positioned events merged to sessions, the streaming relative of interval merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Per key the sessions of events less than `gap` apart: key, start, stop, n. Events later than `late` behind the
    watermark are dropped by Spark; state goes with the watermark, so it is bounded by the open sessions."""
    w = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def windowed_counts(events: DataFrame, keys: list[str], at: str, size: str, late: str) -> DataFrame:
    w = events.withWatermark(at, late).groupBy(*keys, F.window(at, size).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(*keys, F.col("w.start").alias("start"), "n")
