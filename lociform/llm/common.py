"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes an Arrow batch may hold; with it a batch of very long texts stays small.
ARROW_BATCH_BYTES = 16 << 20


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="lociform-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session (tests) gets an own one where
    it is unset; on a cluster that is an error, since a folder of the driver's machine is not shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        path = "file://" + _own_dir()
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and return the written table (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = scratch(spark, label)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")  # the written table replaces the shuffles behind it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lociform_path = path
    if _scopes:
        _scopes[-1].add(path)
    return out


#: Paths written by materialize() in each tables_of() that is open, the innermost last.
_scopes: list[set[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from materialize() that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._lociform_path)
        for s in _scopes:
            s.discard(t._lociform_path)


@contextlib.contextmanager
def tables_of(spark: SparkSession) -> Iterator[Callable]:
    """Tables that materialize() writes inside are deleted at the end, but for those passed to what this yields."""
    _scopes.append(set())

    def keep(*tables: DataFrame) -> None:
        for t in tables:
            _scopes[-1].discard(t._lociform_path)
            if len(_scopes) > 1:
                _scopes[-2].add(t._lociform_path)

    try:
        yield keep
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


#: A key is hot from this many rows on, and from this share of all rows on; so there are at most HOT_SHARE hot keys.
HOT_ROWS = 4096
HOT_SHARE = 10_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str = "n", how: str = "inner") -> DataFrame:
    """`rows` joined by `key` to `table` (one row a key, `count` being the rows that have it, dropped from the result).

    Hot keys are broadcast, at most HOT_SHARE of them by their definition, so their rows stay where they are; only rows of
    other keys are shuffled. `rows` and `table` are read twice if there is a hot key and should be written tables.
    """
    from pyspark.sql import functions as F

    figures = table.agg(F.sum(count).alias("all"), F.max(count).alias("most")).first()
    hot = max(HOT_ROWS, -(-(figures["all"] or 0) // HOT_SHARE))
    if (figures["most"] or 0) <= hot:
        return rows.join(table.drop(count), key, how)
    top = table.where(F.col(count) > hot).drop(count)
    rest = table.where(F.col(count) <= hot).drop(count)
    cold = rows.join(F.broadcast(top.select(key)), key, "left_anti").join(rest, key, how)
    return rows.join(F.broadcast(top), key).unionByName(cold)


def batch_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key).isdigit() or int(spark.conf.get(key)) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes below `df`, for file scans the size of the files; 0 where it has none."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = int(size if isinstance(size, int) else size.toString())
    return 0 if size >= 1 << 56 else size


def parts_for(df: DataFrame, bytes_per_part: int, least: int) -> int:
    return max(least, math.ceil(plan_bytes(df) / bytes_per_part))


def as_binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1, bytes) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    buffers = column.buffers()
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def byte_values(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def components(spark: SparkSession, edges: DataFrame, label: str) -> DataFrame:
    """Connected components of `edges` (a, b) as (node, root), the root being the smallest node.

    Alternating large-star and small-star rewiring: every step is a group by node with a partial minimum and a
    join, links are never gathered in one place, and each round is written to the shared folder and replaces the one before
    it there. A node with very many neighbours does not gather them: its (node, minimum) is broadcast to them.
    """
    from pyspark.sql import functions as F

    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = materialize(cur, label)
    stamp = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))).first())
    before = stamp(cur)
    while before[0]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")), label)
        # large star: larger neighbours point at the smallest node around u
        large = spread_join(both.where("v > u"), low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, label)
        # small star: u and its smaller neighbours point at the smallest of them
        low2 = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), label)
        small = (
            spread_join(large, low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low2.select("a", F.col("m").alias("b")))
            .distinct()
        )
        small = materialize(small, label)
        discard(cur, low, large, low2)
        cur, after = small, stamp(small)
        if after == before:
            break
        before = after
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._lociform_path = cur._lociform_path
    return out
