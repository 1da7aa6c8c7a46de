import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lociform.llm import kneser_ney as K
from lociform.llm.common import as_binary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(low), None]


def brute(train, texts):
    pairs, words = Counter(), Counter()
    for t in train:
        w = split(t)
        words.update(w)
        pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    cont, ctx = Counter(w for _, w in pairs), defaultdict(Counter)
    for (u, w), c in pairs.items():
        ctx[u][w] = c
    times = lambda x: [sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]
    d2, d1 = (0, *K.discounts(*times(pairs))), (0, *K.discounts(*times(cont)))
    n, v, types = sum(words.values()), len(words), len(pairs)
    spare = sum(d1[min(c, 3)] for c in cont.values()) / types if types else 1.0

    def low(w):
        c = cont[w]
        return (max(c - d1[min(c, 3)], 0) / types if types else 0) + spare / (v + 1)

    def p(u, w):
        if u not in ctx:
            return low(w)
        total = sum(ctx[u].values())
        c = ctx[u][w]
        gamma = sum(d2[min(x, 3)] for x in ctx[u].values() if x) / total
        return max(c - d2[min(c, 3)], 0) / total + gamma * low(w)

    out = []
    for t in texts:
        w = split(t)
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        own = sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w[:-1]], w, strict=True))
        out.append((len(w), sum(words[x] > 0 for x in w), round(base, 6), round(own, 6)))
    mass = [sum(p(u, w) for w in words) + p(u, "never seen") for u in ["<s>", *list(words)[:5]]]
    return n, out, mass


def texts():
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(30)] + ["É", "ß\x1fx", "日本"]
    weight = [1 / (k + 1) for k in range(len(vocab))]
    make = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choices(vocab, weight, k=n))
    return [None, "", " \n", "A a A a", "a", "\x0bone\x0c", *[make(rng.randint(1, 60)) for _ in range(120)], make(4000), "x" * 3000, "w0 w0 " * 400]


def test_tokens():
    import pyarrow as pa

    rows = texts()
    h, doc = K.tokens(*as_binary(pa.array(rows)))
    want = [split(t) for t in rows]
    assert np.bincount(doc, minlength=len(rows)).tolist() == list(map(len, want))
    flat = [w for x in want for w in x]
    by = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_against_brute_force(spark):
    rows = texts()
    train = [t for k, t in enumerate(rows) if k % 4]
    df = spark.createDataFrame([(k, t, k % 4 > 0, 1.0) for k, t in enumerate(rows)] + [(0, rows[0], False, 2.0)], "doc_id bigint, text string, fit boolean, pack double")
    model = K.fit(df.where("fit"))
    n, want, mass = brute(train, rows)
    assert model.tokens == n
    assert all(abs(m - 1) < 1e-9 for m in mass)
    got = [(r.doc_id, (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))) for r in K.score(df, model, ["doc_id"]).collect()]
    assert sorted(got) == sorted([*enumerate(want), (0, want[0])])


def test_held_out_is_better_than_unigrams(spark):
    rng = random.Random(2)
    follow = {k: [rng.randrange(50) for _ in range(3)] for k in range(50)}

    def walk(n):
        k, out = rng.randrange(50), []
        for _ in range(n):
            k = rng.choice(follow[k])
            out.append(f"w{k}")
        return " ".join(out)

    df = spark.createDataFrame([(k, walk(80)) for k in range(120)], "doc_id bigint, text string")
    model = K.fit(df.where("doc_id < 100"))
    r = K.score(df.where("doc_id >= 100"), model, ["doc_id"]).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.5 * r[1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    model = K.fit(df)
    assert model.tokens == 0 and K.score(df, model, ["doc_id"]).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert K.score(one, model, ["doc_id"]).first().n_known == 0


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    rows = [*texts(), "y" * 5000 + " z", " " * 3000]
    whole = K.all_tokens(pa.array(rows))
    monkeypatch.setattr(K, "HASH_BYTES", 64)
    for a, b in zip(whole, K.all_tokens(pa.array(rows)), strict=True):
        assert a.tolist() == b.tolist()


def test_hot_contexts_and_many_ranges(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id bigint, text string")
    n, want, _ = brute(rows, rows)
    results = []
    for share, ranges, most in ((0.125, 64, 16384), (1e9, 64, 16384), (1e-9, 64, 7), (0.125, 7000, 300)):
        monkeypatch.setattr(K, "HOT_SHARE", share)
        monkeypatch.setattr(K, "LEAST_RANGES", ranges)
        monkeypatch.setattr(K, "OPEN_MOST", most)
        model = K.fit(df)
        assert model.ranges == ranges and K.BEGIN in model.hot
        results.append(sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in K.score(df, model, ["doc_id"]).collect()))
    assert all(r == sorted((k, *w) for k, w in enumerate(want)) for r in results)
