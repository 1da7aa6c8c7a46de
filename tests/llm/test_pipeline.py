"""The pipeline against plain Python over a small corpus whose near copies are clear-cut."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from lociform.llm import rake_mix, rule_ledger, suffix_dedup

P = pytest.importorskip("public_tokenizers")
T = pytest.importorskip("tokenizers")


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = "é" + text(60) + "é"
    docs = []
    for _ in range(40):
        docs.append(text(rng.randint(60, 200)))
    for t in docs[:10]:
        w = t.split()
        w[len(w) // 2] = "altered"
        docs += [t, " ".join(w)]
    docs += [text(70) + " " + passage + " " + text(70) for _ in range(12)]
    docs += [None, "", "too short", "%%% word " * 80, "same again " * 100, text(80).upper().replace(" ", "!! ") + "!!"]
    sources, langs = ["a", "a", "b", None], ["en", "de"]
    return [(k, t, rng.choice(langs), rng.choice(sources), len(t or "")) for k, t in enumerate(docs)]


def kept_by_rules(text):
    m = dict(zip(rule_ledger.MEASURES, rule_ledger.measure(text or ""), strict=True))
    return not any(eval(rule.replace(" OR ", " or "), {}, m) for rule in rule_ledger.RULES.values())


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def near_alone(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def without_passages(rows, window=200):
    raws = [r[1].encode() for r in rows]
    seen = {}
    for d, raw in enumerate(raws):
        for i in range(len(raw) - window + 1):
            seen.setdefault(raw[i : i + window], []).append((d, i))
    out = []
    gone = [np.zeros(len(r) + 1, bool) for r in raws]
    for places in seen.values():
        for d, i in places if len(places) > 1 else []:
            gone[d][i : i + window] = True
    for r, raw, g in zip(rows, raws, gone, strict=True):
        edge = np.flatnonzero(np.diff(np.r_[0, g.astype(int)]))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        t = suffix_dedup.cut(raw, suffix_dedup.whole_characters(raw, spans)).decode()
        out.append((r[0], t, r[2], r[3], len(t)))
    return out


def sampled(rows):
    from test_rake_mix import brute

    got, *_ = brute([(r[0], r[1], r[3], r[2]) for r in rows], rake_mix.BUDGET)
    ids = {r[0] for r in got if r[-1]}
    return [r for r in rows if r[0] in ids]


def test_against_plain_python(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    wants = [[r for r in rows if kept_by_rules(r[1])]]
    for step in (near_alone, without_passages, sampled):
        wants.append(step(wants[-1]))
    assert [len(w) for w in wants[:2]] == [len(wants[0]), len(wants[0]) - 20]
    assert any("é" not in r[1] and "é" in rows[r[0]][1] for r in wants[2])
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], wants, strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(tuple, docs.collect())) == sorted(want), name
    own = T.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = set()
    for r in wants[-1]:
        ids = own.encode(r[1], add_special_tokens=False).ids
        want.add((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
