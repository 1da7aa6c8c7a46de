"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are summed to cells of their margins (source, language, topic). Raking scales the cells' sampling probabilities to
one margin's target tokens after the other until every margin holds within a tolerance. A probability never exceeds 1: what
a full cell cannot give is taken from the other cells of the margin's value, and what a whole value cannot give from the other
values. A document is then sampled with its cell's probability, decided by a hash of its id. Everything is DataFrame
functions; only cells are ever raked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join, tables_of

#: Raking stops when no margin misses a target by more than this share of the sample's tokens, looked at after every block of
#: sweeps, or after the most sweeps, where targets contradict each other.
TOLERANCE = 1e-4
BLOCK_SWEEPS = 4
MOST_SWEEPS = 48
#: Margin -> exponent: a value's target share is its share of tokens to this power, made to sum to one.
TEMPERING = {"source": 0.7, "lang": 0.8, "topic": 0.8}
#: Share of all tokens that the sample holds where no probability reaches 1.
BUDGET = 0.7
#: Cells up to this number are raked in one task, with no shuffle; more are raked by grouped sums and joins.
ONE_TASK_CELLS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A text's form as its topic: table (has |), figures (has a digit) or prose; null is prose."""
    return F.when(F.contains(text, F.lit("|")), "table").when(F.rlike(text, F.lit("[0-9]")), "figures").otherwise("prose")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def cells_of(rows: DataFrame, margins: list[str]) -> DataFrame:
    return rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def tempered(cells: DataFrame, margin: str, power: float, budget: float = BUDGET) -> DataFrame:
    """(margin, target): tokens that the sample should have of each value, in sum `budget` of all tokens.

    Targets are in proportion to the tokens' `power`; a value that has fewer gives all it has, and the others share the rest.
    """
    t = materialize(cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")), "rake-margin")
    rate, full = 0.0, -1
    while True:
        whole = F.col("t") < rate * F.pow("t", F.lit(power))
        s = t.agg(F.sum("t").alias("all"), F.sum(F.when(whole, F.col("t")).otherwise(0.0)).alias("given"), F.sum(F.when(whole, 0.0).otherwise(F.pow("t", F.lit(power)))).alias("open"), F.count_if(whole).alias("n")).first()
        if s.n <= full or not s.open:
            break
        full, rate = s.n, (budget * s["all"] - s.given) / s.open
    return t.select(margin, F.least(F.col("t"), rate * F.pow("t", F.lit(power))).alias("target"))


def _step(have: Column, full: Column, free: Column, target: Column) -> Column:
    """The probability of a cell after a margin's step: shrunk in proportion, or grown by what cells at 1 cannot give."""
    p = F.col("p")
    grown = F.when((p >= 1.0) | (free <= 0.0), p).otherwise(F.least(F.lit(1.0), p * F.greatest(F.lit(1.0), F.try_divide(target - full, free))))
    return F.when(target.isNull() | (have <= 0.0), p).when(target <= have, p * F.try_divide(target, have)).otherwise(grown)


def _tokens() -> tuple[Column, Column, Column]:
    """Of the cells of a value: sampled tokens, those of cells at probability 1, those of the others."""
    have = F.col("tokens") * F.col("p")
    return F.sum(have), F.sum(F.when(F.col("p") >= 1.0, have).otherwise(0.0)), F.sum(F.when(F.col("p") < 1.0, have).otherwise(0.0))


def misses(cells: DataFrame, margins: list[str]) -> DataFrame:
    """(margin, value, have, target, miss) of raked cells that still have their target columns; miss is a share of all targets."""
    out = None
    for m in margins:
        g = cells.where(F.col(f"__{m}").isNotNull()).groupBy(F.col(m).alias("value")).agg(F.sum(F.col("tokens") * F.col("p")).alias("have"), F.max(f"__{m}").alias("target"))
        g = g.select(F.lit(m).alias("margin"), "value", "have", "target")
        out = g if out is None else out.unionAll(g)
    every = out.groupBy("margin").agg(F.sum("target").alias("__all"))
    return out.join(F.broadcast(every), "margin").select("margin", "value", "have", "target", F.coalesce(F.try_divide(F.abs(F.col("have") - F.col("target")), F.col("__all")), F.lit(0.0)).alias("miss"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], start: float = BUDGET, tolerance: float = TOLERANCE, most: int = MOST_SWEEPS, one_task: int = ONE_TASK_CELLS) -> tuple[DataFrame, float]:
    """(`cells` with their probability p and the targets as columns __<margin>, the largest miss).

    A target frame has (margin, target in tokens). Values without a target keep their probabilities; cells without tokens
    keep theirs too.
    """
    x = cells
    for m, t in targets.items():
        x = x.join(t.withColumnRenamed("target", f"__{m}"), m, "left")
    x = materialize(x.withColumn("p", F.lit(float(start))), "rake")
    small = x.count() <= one_task
    sweeps = 0
    while True:
        miss = misses(x, list(targets)).agg(F.max("miss")).first()[0] or 0.0
        if miss <= tolerance or sweeps >= most:
            return x, miss
        y = x.coalesce(1) if small else x
        for _ in range(BLOCK_SWEEPS):
            for m in targets:
                if small:
                    w = Window.partitionBy(m)
                    y = y.withColumn("p", _step(*(s.over(w) for s in _tokens()), F.col(f"__{m}")))
                else:
                    have, full, free = _tokens()
                    now = materialize(y.groupBy(m).agg(have.alias("__have"), full.alias("__full"), free.alias("__free")), "rake")
                    y = y.join(now, m).withColumn("p", _step(F.col("__have"), F.col("__full"), F.col("__free"), F.col(f"__{m}"))).drop("__have", "__full", "__free")
            if not small:
                y = materialize(y, "rake")
        y = materialize(y, "rake") if small else y
        discard(x)
        x, sweeps = y, sweeps + BLOCK_SWEEPS


def chance(key: Column) -> Column:
    """A uniform number in [0, 1) fixed by the key (null counts as the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", tempering: dict[str, float] | None = None, budget: float = BUDGET, topic: str | None = None) -> DataFrame:
    """`keep` columns, source, lang, topic, n_tokens, weight, probability, selected and miss, one row per input row.

    probability is calibrated: the expected tokens of every source, language and topic are their targets up to `miss`, the
    largest one left. weight = probability / budget. `topic` names a column with the documents' topics; without it a text's
    form is its topic. Null source, language or topic is a value of its own, written as empty; a null or empty text has no
    tokens and keeps its cell's probability. Rows repeated or with one key are decided alike. A very long text is counted
    whole. An empty table gives no rows. Kept columns must not be named like the result's.
    """
    tempering = TEMPERING if tempering is None else tempering
    t = F.col(f"`{text}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
        (topic_of(t) if topic is None else F.coalesce(F.col(f"`{topic}`").cast("string"), F.lit(""))).alias("topic"), tokens_of(t).alias("n_tokens"), chance(F.col(f"`{key}`")).alias("chance"),
    )
    margins = ["source", "lang", "topic"]
    cells = materialize(cells_of(rows, margins), "rake-cells")
    with tables_of(docs.sparkSession) as keep_table:
        raked, miss = rake(cells, {m: tempered(cells, m, p, budget) for m, p in tempering.items()}, budget)
        keep_table(raked)
    raked = raked.select(*margins, F.round(F.col("p") / budget, 9).alias("weight"), F.round("p", 9).alias("probability"), F.col("n_docs").alias("n"))
    out = spread_cells(rows, raked, margins)
    return out.select("__keep.*", *margins, "n_tokens", "weight", "probability", (F.col("chance") < F.col("probability")).alias("selected"), F.round(F.lit(miss), 5).alias("miss"))


def spread_cells(rows: DataFrame, cells: DataFrame, margins: list[str]) -> DataFrame:
    """`rows` joined to their cell; documents of large cells stay where they are."""
    key = F.concat_ws("\x01", *margins)
    return spread_join(rows.withColumn("__cell", key), cells.withColumn("__cell", key).drop(*margins), "__cell").drop("__cell")


def mix_stage(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The sampled documents with their own columns."""
    names = docs.columns
    packed = docs.select("doc_id", "text", "source", "lang", F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    return mix(packed, ["__row"], budget=budget).where("selected").select("__row.*")
