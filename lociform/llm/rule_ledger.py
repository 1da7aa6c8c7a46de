"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule and is stored;
policies are versioned masks over those bits and are applied, compared and ablated on the stored ledger without reading a
text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_limits, materialize

#: Symbols counted by n_symbols.
SYMBOLS = "#*$%&|<>"
#: ASCII white space: everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"

#: Rule name -> SQL predicate over the measurements that is true where the rule fails. A rule's bit is its place.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "shouting": "2 * n_bangs > n_words",
}
#: Policy version -> the rules it applies. `base` must come first in every later one.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines"],
    "v2": ["few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs"]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    v = len(place)
    if v < 2_000_000:
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        _, pairs = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)
        keys = pairs * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= often
    return int(marked.sum())


def measure(text: str) -> tuple[int, ...]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        text.count("!"),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
        cols = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(c, pa.int64()) for c in cols], names=batch.schema.names[:-1] + [f"__{m}" for m in MEASURES])


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """`keep` columns (default doc_id), the measurements and `fail_bits`, one row per input row.

    A null text has no words. Empty tables give empty ledgers; repeated rows give repeated rows; a kept column
    named like a measurement is refused, since one of the two would hide the other. A very long text is measured whole.
    """
    keep = ["doc_id"] if keep is None else keep
    rules = RULES if rules is None else rules
    if clash := set(keep) & {*MEASURES, "fail_bits"}:
        raise ValueError(f"kept columns clash with measurements: {sorted(clash)}")
    batch_limits(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"__{m} bigint" for m in MEASURES])
    out = src.mapInArrow(_measure_batches, types)
    out = out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__{m}").alias(m) for m in MEASURES])
    bits = F.lit(0).cast("bigint")
    for place, predicate in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(predicate), F.lit(1 << place)).otherwise(F.lit(0)).cast("bigint"))
    return out.withColumn("fail_bits", bits)


def stored(book: DataFrame) -> DataFrame:
    """The ledger, written once: what is computed from it does not measure texts again."""
    return materialize(book, "ledger")


def policy_table(spark, rules: dict[str, str] | None = None, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """(policy, rule, bit) of all versions, to be stored beside a ledger."""
    names = list(RULES if rules is None else rules)
    rows = [(p, r, 1 << names.index(r)) for p, rs in (POLICIES if policies is None else policies).items() for r in rs]
    return spark.createDataFrame(rows, "policy string, rule string, bit bigint")


def mask(policy: str, rules: dict[str, str] | None = None, policies: dict[str, list[str]] | None = None) -> int:
    names = list(RULES if rules is None else rules)
    return sum(1 << names.index(r) for r in (POLICIES if policies is None else policies)[policy])


def failed(policy: str, rules: dict[str, str] | None = None, policies: dict[str, list[str]] | None = None):
    """The bits of the policy's rules that a document of the ledger fails."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules, policies)).cast("bigint"))


def apply_policy(book: DataFrame, policy: str, column: str = "kept", rules: dict[str, str] | None = None, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """`book` with whether the policy keeps the document; `rules` are those that the ledger was made with."""
    return book.withColumn(column, failed(policy, rules, policies) == 0)


def sole_rule(policy: str, rules: dict[str, str] | None = None, policies: dict[str, list[str]] | None = None):
    """The rule without which the policy would keep the document that it rejects; null where there is none or several."""
    bits, names = failed(policy, rules, policies), list(RULES if rules is None else rules)
    alone = F.lit(None).cast("string")
    for r in (POLICIES if policies is None else policies)[policy]:
        alone = F.when(bits == 1 << names.index(r), r).otherwise(alone)
    return alone


def ablation(book: DataFrame, policy: str, rules: dict[str, str] | None = None, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and those kept without it.

    Documents are first counted by their failure bits (at most 2^rules groups, combined before the shuffle);
    the rest is bit arithmetic on those few rows.
    """
    every = mask(policy, rules, policies)
    names = list(RULES if rules is None else rules)
    seen = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(every).cast("bigint")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in (POLICIES if policies is None else policies)[policy]])).alias("r")
    x = seen.select("bits", "n", rule).select("bits", "n", "r.rule", "r.bit")
    zero = F.lit(0).cast("bigint")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return x.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(zero)).alias("n_only_this"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(zero)).alias("n_kept_without"),
        F.bit_or("bits").alias("seen_with"),
    )


def quality_stage(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that the policy keeps, with their own columns. A null or empty text has no words and goes."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    return apply_policy(ledger(packed, keep=["row"]), policy).where("kept").select("row.*")
