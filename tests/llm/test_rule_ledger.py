import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociform.llm import rule_ledger as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {k + d for k, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


TEXTS = [None, "", "   \n\t", "a b c", "a b c a b c", "x " * 200, "line one\nline one\n\n \nline one", "é#ü $ b c d \x1f e\x0b\x0cf", "wörd " * 30 + "%%% &&& " * 40, " ".join(f"w{k}" for k in range(20_000))]


def test_measures(spark):
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words int")
    got = {r.doc_id: tuple(r)[1:6] for r in R.ledger(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_policy_and_ablation(spark):
    df = spark.createDataFrame(list(enumerate([*TEXTS, *TEXTS])), "doc_id bigint, text string")
    book = R.ledger(df).cache()
    rows = book.collect()
    kept = {r.doc_id for r in R.apply_policy(book, "v2").where("kept").collect()}
    assert kept == {r.doc_id for r in rows if r.fail_bits & R.mask("v2") == 0}
    table = {r.rule: r for r in R.ablation(book, "v2").collect()}
    for rule, row in table.items():
        bit = 1 << list(R.RULES).index(rule)
        assert row.n_failed == sum(bool(r.fail_bits & bit) for r in rows)
        assert row.n_only_this == sum(r.fail_bits & R.mask("v2") == bit for r in rows)
        assert row.n_kept_without == sum(r.fail_bits & R.mask("v2") & ~bit == 0 for r in rows)


def test_stage_keeps_columns_and_rows(spark):
    good = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([(1, good, "row", 5), (1, good, "row", 5), (2, "short", None, None), (3, None, "x", 1)], "doc_id bigint, text string, row string, n_words int")
    out = R.quality_stage(df)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == [(1, good, "row", 5)] * 2
    assert R.quality_stage(df.where("false")).count() == 0


def test_clash(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id bigint, text string, n_words int")
    with pytest.raises(ValueError):
        R.ledger(df, keep=["doc_id", "n_words"])
    assert R.ledger(df.withColumn("fail_bits", F.lit(7))).first().fail_bits == 17
