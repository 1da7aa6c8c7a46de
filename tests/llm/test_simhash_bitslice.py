import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lociform.llm import simhash_bitslice as S
from lociform.llm.common import components


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def brute_groups(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and bin(fps[x] ^ fps[y]).count("1") <= 2:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def near_set(rng, centres, each):
    fps = []
    for _ in range(centres):
        fp = rng.getrandbits(64)
        for _ in range(each):
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                fp ^= 1 << rng.randrange(64)
            fps.append(fp)
    return fps


def test_within_counts_distances():
    rng = random.Random(1)
    fps = np.unique(np.array(near_set(rng, 20, 30) + [0, 2**64 - 1], np.uint64))
    v = S.planes(fps)
    for radius in (0, 1, 2, 3, 7, 16, 40):
        for probe in fps[::7].tolist():
            want = [k for k, x in enumerate(fps.tolist()) if bin(x ^ probe).count("1") <= radius]
            assert S.within(probe, v, len(fps), radius).tolist() == want


def test_links_connect_what_is_near(spark):
    rng = random.Random(2)
    fps = sorted(set(near_set(rng, 30, 12) + near_set(rng, 1, 250)))
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp bigint")
    want = brute_groups(dict(enumerate(fps)))
    classes = len(set(want.values()))
    for most in (S.FILE_MOST, 3):
        got = components(spark, S.links(df, most), "t").collect()
        roots = {r.node % 2**64: r.root for r in got}
        where = {}
        for k, fp in enumerate(fps):
            where.setdefault(roots.get(fp, fp - 2**64 if fp >> 63 else fp), set()).add(want[k])
        assert all(len(x) == 1 for x in where.values()) and len(where) == classes


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 80))) for _ in range(25)]
    texts = [None, "", " \t", "One", "one TWO", *base]
    for t in base:
        for _ in range(3):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += base[:8] + ["Ünï CÖDE\x1f x y"] * 3
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id bigint, text string, fp string")
    got = S.groups(df, ["doc_id"], "doc_id").collect()
    fps = {k: brute_fp(t) for k, t in enumerate(texts)}
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    assert {r.doc_id: r.component for r in got} == brute_groups(fps)


def test_near_copies_by_similarity(spark):
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(3000)}"
    texts, kind = [], []
    for g in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        kind.append(g)
        for _ in range(rng.choice([0, 2, 3])):
            w = list(base)
            for _ in range(max(1, len(w) // 150)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
            kind.append(g)
    hot = [word() for _ in range(400)]
    for _ in range(60):
        w = list(hot)
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
        kind.append(99)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component for r in S.near_groups(df, ["doc_id"], "doc_id").collect()}
    first = {}
    assert got == {k: first.setdefault(g, k) for k, g in enumerate(kind)}
    small = S.near_links(spark.createDataFrame([(*(lambda f: (f[0] - 2**64 if f[0] >> 63 else f[0], f[1], f[2]))(S.sketch(t.encode())),) for t in texts[-60:]], "fp bigint, sig binary, keys array<bigint>").dropDuplicates(["fp"]), most=7)
    assert components(spark, small, "t").select("root").distinct().count() == 1


def overlapping(tag, shared, size=90):
    """Two texts of `size` five-word shingles each, `shared` of them in common."""
    w = [f"{tag}x{k}" for k in range(size + 4)]
    return " ".join(w), " ".join(w[: shared + 4] + [f"{tag}y{k}" for k in range(size - shared)])


def test_similarity_decides(spark):
    # 80 of 100 shingles are 0.8; 79 of 101 are below
    texts = [t for k in range(200) for t in overlapping(f"p{k}", 80 if k < 100 else 79)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component for r in S.near_groups(df, ["doc_id"], "doc_id").collect()}
    assert got == {k: k // 2 * 2 if k < 200 else k for k in range(400)}


def test_large_files_keep_all_pairs(spark):
    # 40 pairs, each similar only inside, all under one hot key
    rows = []
    for g in range(40):
        for t in overlapping(f"h{g}", 85):
            f = S.sketch(t.encode())
            rows.append((len(rows), f[0] - 2**64 if f[0] >> 63 else f[0], f[1], [7]))
    df = spark.createDataFrame(rows, "node bigint, fp bigint, sig binary, keys array<bigint>")
    for most in (5, 500):
        root = {r.node: r.root for r in components(spark, S.near_links(df, most=most), "t").collect()}
        assert all(root.get(k, k) == root.get(k + 1, k + 1) for k in range(0, 80, 2))


def test_confirmed_blocks(spark):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        w = [f"g{g}w{k}" for k in range(60)]
        for _ in range(rng.choice([1, 2, 9])):
            a = rng.randrange(8)
            texts.append(" ".join(w[a : a + 50]))
    texts = sorted(set(texts), key=lambda t: (len(t), t))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    want = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            want[i] = min(want[j] for j, y in enumerate(sets) if len(x & y) / len(x | y) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    for most in (4, 500):
        got = {r.node: r.root for r in S.confirmed(df, df.select("node", F.lit(0).cast("bigint").alias("root")), most=most).collect()}
        assert [got.get(k, k) for k in range(len(texts))] == want


def test_stage(spark):
    df = spark.createDataFrame([(2, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (3, None, None), (None, "q r s", "z")], "doc_id bigint, text string, component string")
    out = S.dedup_stage(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a b c d", "y"), (3, None, None), (None, "q r s", "z")], key=str)
    assert S.dedup_stage(df.where("false")).count() == 0


def test_stage_without_ids(spark):
    near = overlapping("n", 85)
    rows = [(None, "a b c"), (None, "d e f"), (None, "d e f"), (4, "g h i"), (4, "j k l"), (5, near[0]), (None, near[1])]
    got = S.dedup_stage(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "a b c"), (None, "d e f"), (4, "g h i"), (4, "j k l"), (5, near[0])], key=str)


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(spark, edges, "t").collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}
    assert components(spark, edges.where(F.lit(False)), "t").count() == 0


def test_near_copies_by_degree_of_edits(spark):
    """Copies with words replaced, dropped and inserted up to a similarity of 0.8 are found, others at 0.7 and below are not."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    grams = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, wanted, unwanted = [], 0, 0
    kept = {}
    for k in range(150):
        base = [word() for _ in range(rng.randint(60, 400))]
        rows.append((2 * k, " ".join(base)))
        other = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 30))):
            at = rng.randrange(len(other))
            other[at : at + rng.choice([0, 1])] = [word()] if rng.random() < 0.7 else []
        a, b = grams(base), grams(other)
        kept[2 * k + 1] = len(a & b) / len(a | b) >= 0.8
        rows.append((2 * k + 1, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component for r in S.near_groups(df, ["doc_id"], "doc_id").collect()}
    for d, near in kept.items():
        wanted += near and got[d] != d - 1
        unwanted += not near and got[d] == d - 1
    assert sum(kept.values()) > 50 and not all(kept.values())
    assert wanted == 0 and unwanted == 0


def test_hot_groups_and_tables_left(spark, monkeypatch, tmp_path):
    import os

    from lociform.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(k, " ".join(base)) for k in range(60)]
    for k in range(60, 120):
        other = list(base)
        other[k] = "changed"
        rows.append((k, " ".join(other)))
    rows += [(k, f"alone {k} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))) for k in range(120, 160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in S.dedup_stage(df).collect()) == [0, *range(120, 160)]
    assert len(os.listdir(tmp_path)) == 1  # what the result reads
    got = {r.doc_id: r.component for r in S.groups(df, ["doc_id"], "doc_id").collect()}
    assert all(got[k] == 0 for k in range(60)) and len(got) == 160


def test_no_local_folder_on_a_cluster(monkeypatch):
    import pytest

    from lociform.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**5)}" for _ in range(200_000)]
    other = list(base)
    other[500] = "changed"
    rows = [(1, " ".join(base), "x", 1), (2, " ".join(other), "y", 2), (3, "short text of a few words only", "z", 3), (None, None, None, None), (None, "  ", "q", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component int")
    got = S.groups(df.select("doc_id", "text"), ["doc_id"], "doc_id").collect()
    assert {r.doc_id: r.fp % 2**64 for r in got if r.doc_id} == {k: brute_fp(t) if k == 3 else S.fingerprint(t.encode()) for k, t, *_ in rows[:3]}
    kept = S.dedup_stage(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.fp or "") for r in kept.collect())[1:] == [(1, "x"), (3, "z")] and kept.count() == 3
