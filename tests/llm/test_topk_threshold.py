import math
import random

import numpy as np

from lociform.llm import topk_threshold as T


def brute(queries, rows, k):
    def q(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    out = set()
    for qi, qv in queries:
        a = q(qv)
        if a is None or qi is None:
            continue
        got = []
        for ci, cv in rows:
            b = q(cv)
            if b is not None and ci is not None and ci != qi:
                got.append((-sum(x * y for x, y in zip(a, b, strict=False)), ci))
        out |= {(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(sorted(got)[:k])}
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    vec = lambda: [float(np.float32(rng.gauss(0, 0.3))) for _ in range(8)]
    rows = [(k, vec()) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(60)] + [(400, None), (401, [0.0] * 8), (402, []), (403, [1.0]), (404, [float("nan")] * 8), (405, [float("inf")] + [0.0] * 7), (406, [None] + [0.1] * 7), (None, vec()), (500, [3e4] * 8), (450, [-0.001] * 8)]
    rows += [(3, rows[3][1])]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0] + [(402, []), (401, [0.0] * 8)]
    qs = spark.createDataFrame(queries, "id bigint, vector array<float>")
    for shard, block in ((64, 3), (8192, 512)):
        got = {tuple(r) for r in T.search(qs, df, 5, shard_rows=shard, block=block).collect()}
        assert got == brute(queries, rows, 5)
    few = df.where("id < 3")
    assert {tuple(r) for r in T.search(few, few, 5).collect()} == brute(rows[:3], rows[:3], 5)
    assert T.search(qs.where("false"), df).count() == 0 and T.search(qs, df.where("false")).count() == 0


def test_threshold_stops_early():
    m = np.zeros((4096, 6), np.int64)
    m[:, 0] = np.arange(4096)
    m[:, 1] = np.arange(4096) // 7
    s = T.Shard(np.arange(4096), m)
    ids, scores = s.top(np.array([5, 2, 0, 0, 0, 0]), None, 3)
    assert ids.tolist() == [4095, 4094, 4093] and s.steps == 1


def test_columns_that_clash_and_many_pairs(spark):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(6)], 1, 2, 3) for k in range(500)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>, shard int, score int, rank int")
    q = [r[:2] for r in rows if r[0] % 3 == 0]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in T.search(df.where("id % 3 = 0"), df, 4, shard_rows=60, block=25).collect()}
    assert got == brute(q, [r[:2] for r in rows], 4)


def test_products_beyond_floats(spark):
    rows = [(1, [float(2**20), 1.0]), (2, [float(2**20), 2.0]), (3, [float(2**20), 3.0]), (4, [-float(2**20), 0.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in T.search(df, df, 3).collect()}
    assert got == brute(rows, rows, 3)
