"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rule_ledger as R

    book = R.stored(R.ledger(_table(spark, sf_dir, "documents")))
    book = R.apply_policy(R.apply_policy(book, "base", "base_kept"), "v2")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "n_lines", "n_bangs", "fail_bits", R.sole_rule("v2").alias("sole_rule"))


def op10_bpe_speculative(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe_speculative as B

    return B.digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_simhash_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash_bitslice as S

    g = S.groups(_table(spark, sf_dir, "documents"), ["doc_id"], "doc_id")
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup as S

    return S.digests(_table(spark, sf_dir, "documents"))


#: (host, path, verdict) of the url rules of op9.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_sweep as U

    rules = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES])).alias("r")).select("r.*")
    return U.judge(_table(spark, sf_dir, "pages"), rules)


def op7_chat_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_fold as C

    probe = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe.alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return C.read_back(C.format_events(C.streamed(C.messages(rows)))).withColumnRenamed("conv", "conv_id")


def op3_rake_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rake_mix as R

    return R.mix(_table(spark, sf_dir, "documents"), ["doc_id"])


def _rake_sql(budget: float = 0.7, tolerance: float = 1e-4, block: int = 4, most: int = 48) -> str:
    """The same raking as a recursion of sweeps, and the margins' targets by the prefix of values that give all they have."""
    powers = {"source": 0.7, "lang": 0.8, "topic": 0.8}
    steps = [r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)"""]
    for m, p in powers.items():
        steps.append(f"m_{m} AS (SELECT {m}, sum(tokens) AS t FROM c GROUP BY {m})")
        steps.append(f"x_{m} AS (SELECT {m}, t, coalesce(sum(t) OVER (ORDER BY t, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given, sum(pow(t, {p})) OVER (ORDER BY t DESC, {m} DESC) AS rest, sum(t) OVER () AS everything FROM m_{m})")
        steps.append(f"r_{m} AS (SELECT min_by(({budget} * everything - given) / rest, t) AS rate FROM x_{m} WHERE rest > 0 AND t >= ({budget} * everything - given) / rest * pow(t, {p}))")
        steps.append(f"t_{m} AS (SELECT {m}, least(t, rate * pow(t, {p})) AS target FROM m_{m}, r_{m})")
    joins = " ".join(f"LEFT JOIN t_{m} USING ({m})" for m in powers)
    miss = ", ".join(f"abs(sum(tokens * p) OVER (PARTITION BY {m}) - g_{m}) / {budget} / nullif(sum(tokens) OVER (), 0)" for m in powers)
    src = "s"
    for m in powers:
        w = f"OVER (PARTITION BY {m})"
        src = f"""(SELECT * EXCLUDE (p, have, fixed, free), CASE WHEN g_{m} IS NULL OR have <= 0 THEN p WHEN g_{m} <= have THEN p * g_{m} / have WHEN p >= 1 OR free <= 0 THEN p
  ELSE least(1, p * greatest(1, (g_{m} - fixed) / free)) END AS p FROM (SELECT *, sum(tokens * p) {w} AS have, sum(CASE WHEN p >= 1 THEN tokens * p ELSE 0 END) {w} AS fixed, sum(CASE WHEN p < 1 THEN tokens * p ELSE 0 END) {w} AS free FROM {src}))"""
    cols = "source, lang, topic, tokens, g_source, g_lang, g_topic"
    steps.append(f"s0 AS (SELECT 0 AS k, c.*, {', '.join(f't_{m}.target AS g_{m}' for m in powers)}, {budget}::DOUBLE AS p FROM c {joins})")
    steps.append(f"s AS (SELECT k, {cols}, p, max(worst) OVER () AS miss FROM (SELECT *, greatest({miss}) AS worst FROM s0) UNION ALL SELECT k, {cols}, p, max(worst) OVER () AS miss FROM (SELECT *, greatest({miss}) AS worst FROM (SELECT k + 1 AS k, {cols}, p FROM {src} WHERE k < {most} AND (k % {block} <> 0 OR miss > {tolerance}))))")
    steps.append(f"r AS (SELECT source, lang, topic, round(p / {budget}, 9) AS weight, round(p, 9) AS probability, round(coalesce(miss, 0), 5) AS miss FROM s WHERE k = (SELECT max(k) FROM s))")
    return ",\n".join(steps) + """
SELECT doc_id, source, lang, topic, n_tokens, weight, probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0 < probability AS selected, miss FROM d JOIN r USING (source, lang, topic)"""


def op1_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk_threshold as T

    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return T.search(rows.where("id % 50 = 0"), rows, 5)


def op2_repair_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair_output as R

    return R.round_trip(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kneser_ney as K

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("held_out"))
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    model = K.fit(docs.where("NOT held_out"))
    out = K.score(docs, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


QUERIES = {
    "op5_kneser_ney": op5_kneser_ney,
    "op2_repair_output": op2_repair_output,
    "op1_topk_threshold": op1_topk_threshold,
    "op3_rake_mix": op3_rake_mix,
    "op7_chat_fold": op7_chat_fold,
    "op9_url_sweep": op9_url_sweep,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op6_simhash_bitslice": op6_simhash_bitslice,
    "op4_rule_ledger": op4_rule_ledger,
    "op10_bpe_speculative": op10_bpe_speculative,
}

ORACLE_SQL = {
    "op1_topk_threshold": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= 5""",
    "op3_rake_mix": _rake_sql(),
    "op7_chat_fold": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '%', '%25'), '<|', '%3C|'), '<s>', '%3Cs>'),
      '</s>', '%3C/s>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]'), '<<SYS>>', '%3C<SYS>>'), '<</SYS>>', '%3C</SYS>>') AS body
  FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_url_sweep": r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
f AS (
  SELECT h.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, r.host || r.path) AS n
  FROM h LEFT JOIN rules r ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path))
SELECT page_id, host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1""",
    "op4_rule_ledger": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
tri AS (
  SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1)::BIGINT)) AS i FROM w)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > word_chars)::INT
    + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
    + 32 * (2 * n_bangs > n_words)::INT)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 63) = 0 AS kept, n_lines, n_bangs, fail_bits,
       CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines'
         WHEN 16 THEN 'word_length' WHEN 32 THEN 'shouting' END AS sole_rule
FROM b""",
}
