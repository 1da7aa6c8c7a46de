import hashlib
import random

import pytest

from lociform.llm import bpe_speculative as B

P = pytest.importorskip("public_tokenizers")
T = pytest.importorskip("tokenizers")


def texts():
    rng = random.Random(5)
    alphabet = "abcdehilnorstu  \n\t'é1928ß,.!<|>日本́ "
    out = [None, "", " ", "  x  ", "<|endoftext|>", "a<|endoftext|> <|endoftext|", "it's we'll don't 'S", "\r\n\r\n a", "\x00\x7f­", "a" * 3000, "the" * 900, "日本語" * 400]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    return out + out[5:9]


def test_same_as_library(spark):
    own = T.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    all_texts = texts()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(all_texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r for r in B.digests(df, P.path("byte_bpe_50k.json")).collect()}
    ids = {r.doc_id: bytes(r.ids) for r in B.encode(df, P.path("byte_bpe_50k.json")).collect()}
    for k, t in enumerate(all_texts):
        want = own.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in want)
        assert ids[k] == raw, t
        assert got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(own.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_speculation_is_verified():
    c = B.Codec(P.path("byte_bpe_50k.json"))
    words = [" unbelievable", " thouhe", " ererthansh", " eauxmentre", " aaaaaaaaaaaaaaa"] + [f" onin{k}gere" for k in range(200)]
    made = c.learn(words)
    assert c.counts["failed"] < c.counts["proposed"] == len(words)
    import numpy as np

    for w in words:
        assert np.frombuffer(made[w], "<u4").tolist() == c.merge(w.encode())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert B.digests(df, P.path("byte_bpe_50k.json")).count() == 0
