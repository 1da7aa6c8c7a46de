import random

import pytest
from pyspark.sql import functions as F

from lociform.operators import intervals as I

S = "chr string, start bigint, stop bigint, sample_id string, strand string"


def make(seed, n=120, span=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(span)
        out.append((rng.choice(["c1", "c1", "c1", "c2"]), a, a + rng.randint(1, 12), rng.choice("xyz"), rng.choice("+-")))
    return out + out[:5] + [("c3", 0, 1, "x", "+")]


def depth(rows):
    d = {}
    for c, a, b, *_ in rows:
        for p in range(a, b):
            d[c, p] = d.get((c, p), 0) + 1
    return d


def stretches(points):
    out = []
    for c, p in sorted(points):
        if out and out[-1][0] == c and out[-1][2] == p:
            out[-1][2] = p + 1
        else:
            out.append([c, p, p + 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("width", [7, 64, 1 << 17])
def test_merge_coverage_and_sets_are_right_at_any_bin_width(spark, width):
    a, b = make(1), make(2, 60)
    da, db = spark.createDataFrame(a, S), spark.createDataFrame(b, S)
    for distance in (0, 3):
        merged, rows = [], sorted(a)
        for c, s, e, *_ in rows:
            if merged and merged[-1][0] == c and s <= merged[-1][2] + distance:
                merged[-1][2] = max(merged[-1][2], e)
                merged[-1][3] += 1
            else:
                merged.append([c, s, e, 1])
        got = sorted((r.chr, r.start, r.stop, r.n) for r in I.merge(da, distance, [F.count(F.lit(1)).alias("n")], width=width).collect())
        assert got == sorted(map(tuple, merged))
    cov = {}
    for r in I.coverage(da, width=width).collect():
        for p in range(r.start, r.stop):
            cov[r.chr, p] = r.depth
    assert cov == depth(a)
    pa, pb = set(depth(a)), set(depth(b))
    for kind, want in (("intersect", pa & pb), ("subtract", pa - pb), ("union", pa | pb)):
        assert sorted(map(tuple, I.set_algebra(da, db, kind, width).collect())) == stretches(want)


@pytest.mark.parametrize("width", [5, 4096])
def test_overlap_pairs(spark, width):
    a, b = make(3, 80), make(4, 50)
    da, db = spark.createDataFrame(a, S), spark.createDataFrame(b, S)
    pairs = lambda ok: sorted((x, y) for x in a for y in b if x[0] == y[0] and ok(x, y))
    got = lambda **k: sorted((tuple(r)[:5], tuple(r)[5:10]) for r in I.overlap_pairs(da, db, width=width, **k).collect())
    assert got() == pairs(lambda x, y: x[1] < y[2] and y[1] < x[2])
    assert got(closed=True) == pairs(lambda x, y: x[1] <= y[2] and y[1] <= x[2])
    assert got(stranded=True) == pairs(lambda x, y: x[1] < y[2] and y[1] < x[2] and x[4] == y[4])
    assert got(min_overlap=4) == pairs(lambda x, y: min(x[2], y[2]) - max(x[1], y[1]) >= 4)


@pytest.mark.parametrize("width", [9, 1 << 17])
def test_nearest(spark, width):
    a = make(5, 60) + [("only", 5, 9, "x", "+")]
    b = [(c, s, e, k) for k, (c, s, e, *_) in enumerate(make(6, 25))]
    got = I.nearest(spark.createDataFrame(a, S), spark.createDataFrame(b, "chr string, start bigint, stop bigint, id bigint"), "id", width).collect()
    assert len(got) == len(a)
    for r in got:
        gaps = {k: max(0, s - r.stop, r.start - e) for c, s, e, k in b if c == r.chr}
        assert r.distance == min(gaps.values(), default=None)
        assert r.nearest_id is None and not gaps or gaps[r.nearest_id] == r.distance


def test_expand_priority_profile_and_shift(spark):
    df = spark.createDataFrame([("c1", 5, 10, "x", "+"), ("c1", 5, 10, "x", "-"), ("c1", 98, 99, "x", "+"), ("c9", 1, 2, "x", "+")], S)
    sizes = spark.createDataFrame([("c1", 100)], "chr string, size bigint")
    got = [(r.start, r.stop) for r in I.expand(df, 10, 2, sizes, stranded=True).orderBy("chr", "start", "stop").collect()]
    assert sorted(got) == sorted([(0, 12), (3, 20), (88, 100), (0, 4)])
    peaks = spark.createDataFrame([("p1", "c1", 0, 5), ("p2", "c1", 50, 60), ("p3", "c2", 0, 9)], "peak_id string, chr string, start bigint, stop bigint")
    kinds = spark.createDataFrame([("c1", 4, 8, "exon"), ("c1", 2, 3, "promoter"), ("c1", 60, 70, "exon")], "chr string, start bigint, stop bigint, kind string")
    assert {r.peak_id: r.annotation for r in I.annotate_priority(peaks, kinds, ["promoter", "exon"]).collect()} == {"p1": "promoter", "p2": "intergenic", "p3": "intergenic"}
    rows = [
        ("c1", 2, 30, "c1", 10, 40, "plus", "+"), ("c1", 100, 140, "c1", 120, 180, "minus", "-"), ("c1", 2, 9, "c1", 3, 12, "minus at the start", "-"),
        ("c1", 1, 3, "c1", 0, 4, "nothing left", "-"), ("c1", 5, 9, "c2", 5, 9, "two chromosomes", "+"),
    ]
    pairs = spark.createDataFrame(rows, "chr1 string, start1 bigint, stop1 bigint, chr2 string, start2 bigint, stop2 bigint, name string, strand1 string")
    got = {r.name: (r.start, r.stop, r.strand) for r in I.shift_fragments(pairs).collect()}
    assert got == {"plus": (6, 44, "+"), "minus": (95, 175, "-"), "minus at the start": (0, 7, "-")}


def test_empty(spark):
    e = spark.createDataFrame([], S)
    assert I.merge(e).count() == I.coverage(e).count() == I.overlap_pairs(e, e).count() == I.set_algebra(e, e, "union").count() == 0


def test_links_are_signed_by_strand(spark):
    genes = spark.createDataFrame([("a", "c1", 1000, "+", 1.5), ("b", "c1", 1000, "-", 2.5), ("far", "c1", 9000, "+", 0.0)], "gene_id string, chr string, tss bigint, strand string, lfc double")
    peaks = spark.createDataFrame([("p", "c1", 899, 1000), ("edge", "c1", 1499, 1510), ("beyond", "c1", 1500, 1510)], "peak_id string, chr string, start bigint, stop bigint")
    links = I.within(genes, peaks, 500)
    got = {(r.gene_id, r.peak_id): (r.distance_to_tss, r.abs_distance, r.lfc) for r in links.collect()}
    # the middle of 900..1000 is 950; that of 1500..1510 is 1505
    assert got == {("a", "p"): (-50, 50, 1.5), ("b", "p"): (50, 50, 2.5), ("a", "edge"): (505, 505, 1.5), ("b", "edge"): (-505, 505, 2.5)}
    g = {r.gene_id: (r.has_peak, r.n_peaks, r.nearest_peak_distance) for r in I.gene_links(genes, links).collect()}
    assert g == {"a": (True, 2, 50), "b": (True, 2, 50), "far": (False, 0, None)}
    p = {r.peak_id: (r.near_gene, r.n_genes, r.nearest_gene, r.nearest_gene_distance) for r in I.peak_links(peaks, links).collect()}
    assert p == {"p": (True, 2, "a", 50), "edge": (True, 2, "a", 505), "beyond": (False, 0, None, None)}


def test_nearest_has_no_frame_that_shrinks(spark):
    q = spark.createDataFrame([(k, "c1", 10 * k, 10 * k + 3) for k in range(50)], "id bigint, chr string, start bigint, stop bigint")
    plan = I.nearest(q, q.withColumnRenamed("id", "s"), "s")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in plan and "currentrow$(), unboundedfollowing$()" not in plan
