"""URL rules by a sort-merge range join over reversed-host keys.

A host's labels, reversed and each closed by a character below all others, turn "this host and its subdomains" into
one interval of keys, and the rules' intervals nest. Rule boundaries and the distinct hosts are swept in key order; at every
boundary stands the stack of the rules active from there on, and a host takes the stack of the last boundary before
it. Among the active rules whose path starts the url's path the longest wins.

Hosts are swept once each, however many urls they have, and dealt over buckets by their two upper labels; a rule goes to the
bucket of its own, and only rules on a single label, as many as there are top-level domains, go to every bucket. Urls of a
host that carries many of them are not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plan_bytes, spread_join

SEP, END = "\x01", "\x02"
#: Bytes of urls for each sweep bucket.
BUCKET_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, ASCII-lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by SEP: com\x01example\x01www\x01."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), SEP), F.lit(SEP)))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): from each key on, the rules that are active, as an array of structs. Rules: (host, path, verdict).

    An empty or null path fits every url of the host and its subdomains. A rule whose host is empty or null names no host
    and fits no url.
    """
    r = rules.where("host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").select(
        host_key(F.col("host")).alias("open"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "host", "path", "verdict").alias("r")
    )
    hosts = r.select("open").distinct()
    close = lambda c: F.expr(f"concat(substring({c}, 1, length({c}) - 1), '{END}')")
    # an open boundary has the rules of the host and of every domain above it; a close boundary those of what goes on
    levels = hosts.select("open", F.explode(F.expr(f"transform(sequence(1, size(split(open, '{SEP}')) - 1), k -> concat(array_join(slice(split(open, '{SEP}'), 1, k), '{SEP}'), '{SEP}'))")).alias("above"))
    stacked = levels.join(r.withColumnRenamed("open", "above"), "above")
    opened = stacked.groupBy("open").agg(F.collect_set("r").alias("stack")).select(F.col("open").alias("key"), "stack")
    shut = (
        hosts.join(stacked.where("above <> open"), "open", "left").groupBy("open").agg(F.collect_set("r").alias("stack"))
        .select(close("open").alias("key"), "stack")
    )
    return opened.unionAll(shut)


def _bucket(key: Column, buckets: int) -> Column:
    """The bucket of a host's key, or of a boundary's: by its two upper labels."""
    return F.pmod(F.xxhash64(F.array_join(F.slice(F.split(F.translate(key, END, SEP), SEP), 1, 2), SEP)), F.lit(buckets)).cast("int")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", buckets: int | None = None) -> DataFrame:
    """(key, host, path, rule, verdict), one row per input row.

    `rules` has host, path and verdict; see boundaries(). Ties of length go to the smaller rule string. A null url or one
    without :// has an empty host and path and falls to `default`. Repeated rows and repeated rules change nothing; a very
    long url is judged whole; an empty table gives no rows, and empty rules give `default`. Other columns of either table are
    not read, whatever their names.
    """
    buckets = buckets or max(8, plan_bytes(pages.select(F.col(f"`{url}`"))) // BUCKET_BYTES)
    u = pages.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{url}`").alias("__u"))
    u = u.select("__k", host_of(F.col("__u")).alias("host"), path_of(F.col("__u")).alias("path"))
    hosts = u.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("host <> ''")
    hosts = hosts.withColumn("key", host_key(F.col("host")))
    hosts = hosts.withColumn("bucket", _bucket(F.col("key"), buckets))
    b = boundaries(rules)
    stack = b.schema["stack"].dataType
    single = F.size(F.split(F.translate("key", END, SEP), SEP)) <= 2
    every = F.sequence(F.lit(0), F.lit(buckets - 1).cast("int"))
    b = b.withColumn("bucket", F.explode(F.when(single, every).otherwise(F.array(_bucket(F.col("key"), buckets)))))
    swept = hosts.select("bucket", "key", F.lit(1).alias("kind"), "host", "n", F.lit(None).cast(stack).alias("stack")).unionByName(
        b.select("bucket", "key", F.lit(0).alias("kind"), "stack"), allowMissingColumns=True
    )
    w = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = swept.withColumn("active", F.last("stack", ignorenulls=True).over(w)).where("kind = 1")
    ruled = at.select("host", "n", F.expr("filter(active, r -> host = r.host OR endswith(host, concat('.', r.host)))").alias("active")).where("size(active) > 0")
    ruled = materialize(ruled, "url-hosts")
    fit = F.expr("filter(active, r -> startswith(path, r.path))")
    best = F.expr("aggregate(fit, cast(null as struct<size:int,rule:string,host:string,path:string,verdict:string>), (m, r) -> CASE WHEN m IS NULL OR r.size > m.size OR (r.size = m.size AND (r.rule, r.verdict) < (m.rule, m.verdict)) THEN r ELSE m END)")
    out = spread_join(u, ruled, "host", how="left").withColumn("fit", fit).withColumn("best", best)
    return out.select(F.col("__k").alias(key), "host", "path", F.expr("best.rule").alias("rule"), F.coalesce(F.expr("best.verdict"), F.lit(default)).alias("verdict"))
