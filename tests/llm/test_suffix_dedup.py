import hashlib
import random

import numpy as np
import pytest

from lociform.llm import suffix_dedup as S


def brute(raws, window):
    seen = {}
    for d, raw in enumerate(raws):
        for i in range(len(raw) - window + 1):
            seen.setdefault(raw[i : i + window], []).append((d, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + window] = True
    out = []
    for raw, g in zip(raws, gone, strict=True):
        spans = int(np.diff(np.r_[0, g.astype(int)]).clip(0).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~g]) if len(raw) else b""
        out.append((len(raw), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, passage=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(passage // 5) for _ in range(4)]
    docs = [None, "", "ab", "x" * 700, "ab" * 300, "abc def " * 90]
    docs += [text(rng.randint(1, 150)) for _ in range(12)]
    docs += docs[6:10]
    for _ in range(25):
        t = text(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 40) :] + text(rng.randint(0, 60))
        docs.append(t)
    t = docs[8]
    docs += [t[:k] + "Z" + t[k + 1 :] for k in (10, len(t) // 2)]
    docs.append(shared[0] + " | " + shared[0])
    return docs


def test_suffix_array_and_common_prefixes():
    rng = random.Random(4)
    for text in (b"", b"a", b"banana" * 9, bytes(rng.choice(b"ab") for _ in range(700)), b"\x00" * 50 + b"\x01"):
        data = np.frombuffer(text, np.uint8)
        order = S.suffix_array(data, 1 << 12)
        padded = [text[i:] + b"\x00" * (len(text) - i) for i in order]
        assert padded == sorted(padded) and sorted(order.tolist()) == list(range(len(text)))
        for most in (8, 40):
            want = [0] + [next((k for k in range(most) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), most) for a, b in zip(order[1:].tolist(), order[:-1].tolist(), strict=True)]
            assert S.common_prefixes(data, order, most).tolist() == want[: len(order)]


def test_equal_windows_have_equal_anchors():
    data = np.frombuffer(("qwert zuiop " * 3 + "".join(chr(97 + (k * k) % 26) for k in range(900))).encode(), np.uint8)
    doc, start, count, h = S.runs(np.array([0, len(data)]), data)
    assert (doc == 0).all() and start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and start[-1] + count[-1] == len(data) - 199


@pytest.mark.parametrize(("window", "hot"), [(200, 4096), (64, 4096), (64, 3)])
def test_against_brute_force(spark, window, hot):
    docs = corpus(window + hot)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id bigint, text string, rid string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(df, window=window, hot=hot).collect()}
    want = brute([(t or "").encode() for t in docs], window)
    assert {k: v for k, v in got.items()} == dict(enumerate(want))


def test_pieces_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 500)
    docs = corpus(9) + ["".join(corpus(9)[6:30])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").coalesce(1)
    want = brute([(t or "").encode() for t in docs], 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(df).collect()}
    assert got == dict(enumerate(want))


def test_repeated_rows_and_empty(spark):
    t = " ".join(f"w{k}" for k in range(120))
    df = spark.createDataFrame([(1, t), (1, t), (None, "short"), (2, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in S.digests(df).collect()), key=str)
    assert got == sorted([(1, len(t), len(t), 1), (1, len(t), len(t), 1), (None, 5, 0, 0), (2, 0, 0, 0)], key=str)
    assert S.digests(df.where("false")).count() == 0


def test_stage(spark):
    p = "é" * 5 + " ".join(f"p{k}" for k in range(80)) + "é"
    df = spark.createDataFrame([(1, "one " + p + " two", 9, "s"), (2, p, 9, None), (3, None, None, "t"), (4, "clean", 5, "u")], "doc_id bigint, text string, n_chars bigint, key string")
    out = S.dedup_stage(df)
    assert out.columns == df.columns
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {1: ("one  two", 8, "s"), 2: ("", 0, None), 3: (None, None, "t"), 4: ("clean", 5, "u")}


def test_very_long_texts(spark):
    """Texts of several slices: a passage that stands across a slice's end, and a copy of all of a text."""
    import hashlib
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = word(300)
    long = word(S.SLICE - 100) + passage + word(1_200_000)
    rows = [(1, long), (2, word(500) + passage + word(50)), (3, word(1000)), (4, None), (5, "")]
    got = {r.doc_id: r for r in S.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    cut = long.replace(passage, "")
    assert abs(got[1].n_removed - 300) <= 2 and got[1].n_spans == 1 and got[1].n_bytes == len(long)
    assert got[1].kept_sha256 == hashlib.sha256(cut.encode()).hexdigest() or got[1].n_removed > 300
    assert abs(got[2].n_removed - 300) <= 2 and got[3].n_removed == 0 and got[4].n_bytes == got[5].n_bytes == 0
    twice = {r.doc_id: r.n_removed for r in S.digests(spark.createDataFrame([(1, long), (2, long), (None, "x" * 10)], "doc_id bigint, text string")).collect()}
    assert twice == {1: len(long), 2: len(long), None: 0}
