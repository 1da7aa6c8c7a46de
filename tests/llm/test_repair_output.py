import random
import zlib

import numpy as np
import pytest

from lociform.llm import repair_output as R
from lociform.llm.common import scratch

P = pytest.importorskip("public_tokenizers")
T = pytest.importorskip("tokenizers")


def test_compress_round_trip():
    rng = np.random.default_rng(1)
    for n, v in ((0, 5), (1, 5), (5000, 3), (60_000, 40), (4000, 1)):
        ids = (rng.zipf(1.5, n) % v).astype("<u4")
        ends = np.unique(np.r_[np.sort(rng.integers(0, n + 1, 20)), n])
        body = R.pack(ids, ends)
        r = R.ShardReader(body)
        assert (r.all_ids() == ids).all() and r.ends.tolist() == ends.tolist()
        for k in range(len(ends)):
            want = ids[ends[k - 1] if k else 0 : ends[k]]
            assert (r.document(k) == want).all()
            a, b = sorted(rng.integers(0, len(want) + 1, 2).tolist())
            assert (r.document(k, a, b) == want[a:b]).all()
        for a, b, size in zip(r.pairs[:, 0], r.pairs[:, 1], r.lengths, strict=True):
            assert len(R.expand(np.array([a, b]), r.pairs, r.base)) == size
        if n == 60_000:
            assert len(r.symbols) < n / 2 and len(r.pairs)


def test_frequent_pairs_are_exact():
    rng = np.random.default_rng(3)
    for bits in (3, 18):
        for most, least in ((5, 2), (1000, 3), (1000, 50), (7, 1000)):
            keys = rng.zipf(1.3, 4000).astype(np.int64) % 900
            got = R.frequent_pairs(keys, R.bins_of(keys, bits), bits, most, least)
            value, n = np.unique(keys, return_counts=True)
            times = dict(zip(value.tolist(), n.tolist(), strict=True))
            assert len(got) <= most and all(times[k] >= least for k in got.tolist())
            assert len(got) > 0 or not (n >= least).any()
            if bits == 18:
                assert sorted(times[k] for k in got.tolist()) == sorted(n[n >= least].tolist())[-most:]


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(4)
    for _ in range(5):
        ids = (rng.zipf(1.4, 6000) % 60).astype("<u4")
        ends = np.array([0, 1500, 1500, 6000])
        seq, cuts, pairs, base = R.compress(ids, ends, least=4)
        inner = np.ones(len(seq) - 1, bool)
        inner[cuts[(cuts > 0) & (cuts < len(seq))] - 1] = False
        left = (seq[:-1].astype(np.int64) << 32 | seq[1:])[inner]
        # overlapping occurrences of one symbol count twice but can be taken once
        assert all(n < 4 or k >> 32 == k & 0xFFFFFFFF for k, n in zip(*np.unique(left, return_counts=True), strict=True))
        sizes = R.lengths(pairs, base)
        for flat in (None, R.flat_rules(pairs, base, sizes)):
            assert (R.expand(seq, pairs, base, sizes, flat) == ids).all()


def texts():
    rng = random.Random(3)
    alphabet = "abcdeHIlnorstu  \n\té19ß,.!<|>日ǺΣςİǅK\x1c\x85  "
    out = [None, "", " ", "<|endoftext|>x <|startoftext|>", "ΑΣ ΑΣ.", "it's", "a\x1cb\x1dc", "́a ́", "x" * 5000, "\u26bd a\u26bd b", "!\u26bd"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(400)]


def test_same_as_library(spark, monkeypatch):
    own = T.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(k * 7 % 1000, t, 0) for k, t in enumerate(texts())]
    rows += [rows[5], (None, "null key", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(3)
    got = sorted(map(tuple, R.round_trip(df, P.path("word_bpe_49k.json")).collect()), key=lambda r: r[1])
    at, want = 0, []
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.round_trip(df, P.path("word_bpe_49k.json")).count() == 0


def test_files_hold_every_document(spark):
    folder = scratch(spark, "t")
    df = spark.createDataFrame([(k, f"word{k % 3} " * 50) for k in range(40)], "doc_id bigint, text string")
    R.write(df, folder, P.path("word_bpe_49k.json"))
    assert sum(len(R.ShardReader(bytes(r.body))) for r in spark.read.parquet(folder).collect()) == 40
