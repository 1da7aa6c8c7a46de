"""Exact top-k inner product search by Fagin's threshold algorithm.

Vectors are quantised to integers and dealt to shards of bounded size; a shard keeps, per dimension, the list of its
rows sorted by that component. A query reads all lists from their favourable end in step, scores each newly met row
in full, and stops once the threshold (the score that a row standing at the current depth of every list would have)
is below its k-th score: no unseen row can then enter. Queries come in blocks; every block meets every shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_limits, materialize

#: Rows of a shard, and queries of a block: the most, and the least that a table of any size is dealt to.
SHARD_ROWS = 8192
SHARD_LEAST = 1024
BLOCK_QUERIES = 4096
#: Tasks that an input of few shards is still dealt over, and the most tasks of a search.
TASKS = 32
TASKS_MOST = 20_000


def quantise(values: np.ndarray, scale: int = 256) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


def _pack(key: str, scale: int):
    """Rows (group, id, vector) of one group to one row (group, width, ids, components as int64 matrix)."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        lists = table["vector"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(sizes.max(initial=0))
        out = np.zeros((len(ids), width))
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(ids)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)] = flat
        order = np.argsort(ids, kind="stable")
        m = quantise(out, scale)[order].astype(np.int64)
        return pa.table({key: table[key].slice(0, 1), "width": pa.array([width], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "matrix": pa.array([m.tobytes()], pa.binary())})

    return run


class Shard:
    """Ids (ascending), components and the sorted list of each dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.lists = np.argsort(matrix, axis=0, kind="stable").astype(np.int32).T.copy()
        most = int(np.abs(matrix).max(initial=0))
        self.most = most
        self.floats = matrix.astype(np.float64) if most < 1 << 53 else None
        self.steps = 0

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        # floating point is exact while all partial sums stay below 2^53, and its products are faster
        if self.floats is not None and self.most * int(np.abs(q).max(initial=0)) * len(q) < 1 << 53:
            return (self.floats[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.matrix[rows] @ q

    def top(self, q: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than `own`, ties to the smaller id."""
        n, width = self.matrix.shape
        dims = np.flatnonzero(q)
        seen = np.zeros(n, bool)
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, max(4, n // 256)
        while depth < n or not len(dims):
            end = min(n, depth + step) if len(dims) else n
            if len(dims):
                fresh = np.zeros(n, bool)
                up, down = dims[q[dims] > 0], dims[q[dims] < 0]
                fresh[self.lists[up, n - end : n - depth].ravel()] = True
                fresh[self.lists[down, depth:end].ravel()] = True
                fresh &= ~seen
                rows = np.flatnonzero(fresh)
                seen[rows] = True
            else:
                rows = np.arange(n)
            ids = self.ids[rows]
            if own is not None:
                rows, ids = rows[ids != own], ids[ids != own]
            got = self.scores(rows, q)
            if len(best) == k:
                good = got >= best[-1]
                ids, got = ids[good], got[good]
            if len(ids):
                ids, got = np.concatenate([best_id, ids]), np.concatenate([best, got])
                order = np.lexsort((ids, -got))[:k]
                best_id, best = ids[order], got[order]
            depth = end
            self.steps += 1
            if depth >= n:
                break
            if len(best) == k:
                edge = np.where(q[dims] > 0, self.matrix[self.lists[dims, n - depth], dims], self.matrix[self.lists[dims, depth - 1], dims])
                # an unseen row scores at most this; an equal score could still win by its smaller id
                if int((edge * q[dims]).sum()) < best[-1]:
                    break
            step *= 2
        return best_id, best


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["s_ids"], np.int64)
                shard = Shard(ids, np.frombuffer(r["s_matrix"], np.int64).reshape(len(ids), r["s_width"]))
                qids = np.frombuffer(r["ids"], np.int64)
                qs = np.frombuffer(r["matrix"], np.int64).reshape(len(qids), r["width"])
                width = shard.matrix.shape[1]
                fit = np.zeros((len(qids), width), np.int64)
                fit[:, : min(width, r["width"])] = qs[:, :width]
                found = [shard.top(q, int(i), k) for i, q in zip(qids, fit, strict=True)]
                counts = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qids, counts), pa.int64()), pa.array(np.concatenate([i for i, _ in found]), pa.int64()), pa.array(np.concatenate([s for _, s in found]), pa.int64())],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def search(queries: DataFrame, rows: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, its own id excepted; all if there are fewer.

    Both frames are (id bigint, vector array). Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part. A shorter vector counts as padded with zeros. Rows repeated with one id are
    candidates each; equal scores rank by the smaller id. An empty table of either kind gives an empty result. Columns
    other than id and vector are not read, whatever their names. Scores are 64-bit integers: scaled components must stay
    below 2^31 / sqrt(dimensions) in size; products are summed in floating point only where width x largest product < 2^53.

    Every pair of a shard and a block of queries is one row of a sort-merge join and one call of the search, so neither
    side is ever held or sorted as more than its own rows, and tasks are as many as pairs.
    """
    spark = rows.sparkSession
    batch_limits(spark)
    finite = F.expr("id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity'))")
    q, c = queries.where(finite).select("id", "vector"), rows.where(finite).select("id", "vector")
    n, nq = c.count(), q.count()
    shards = max(1, math.ceil(n / shard_rows), min(TASKS, n // SHARD_LEAST))
    blocks = max(1, math.ceil(nq / block))
    tasks = min(TASKS_MOST, shards * blocks)
    kind = "{} bigint, width int, ids binary, matrix binary"
    packed = c.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    packed = packed.groupBy("shard").applyInArrow(_pack("shard", scale), kind.format("shard"))
    packed = materialize(packed.toDF("shard", "s_width", "s_ids", "s_matrix"), "topk-shards")
    asked = q.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)))
    asked = materialize(asked.groupBy("block").applyInArrow(_pack("block", scale), kind.format("block")), "topk-queries")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    left = packed.withColumn("block", every(blocks)).repartition(tasks, "shard", "block")
    right = asked.withColumn("shard", every(shards)).repartition(tasks, "shard", "block")
    pairs = left.hint("merge").join(right, ["shard", "block"])
    part = pairs.select("shard", "s_width", "s_ids", "s_matrix", "width", "ids", "matrix").mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
