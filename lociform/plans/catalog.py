"""The engine's queries over the driver's tables, each with its SQL.

The tables stand in for omics data (integers only, so both sides agree): lineitem rows are fragments and counts, parts
are regions and genes, events are cells by genes, embeddings are cell embeddings, documents are sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import cells as C
from ..operators import clustering as K
from ..operators import editing as E
from ..operators import expression as X
from ..operators import graph as G
from ..operators import intervals as I
from ..operators import models as M
from ..operators import multivariate as MV
from ..operators import penalties as P
from ..operators import plotdata as PD
from ..operators import quality as Q
from ..operators import sequences as SQ
from ..operators import stats as T
from ..operators import values as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the driver's tables as omics tables, and the same in SQL -------------------------------------------------

FRAG = """frag AS (SELECT 'c' || (l_suppkey % 8) AS chr, l_orderkey * 40 + l_linenumber * 7 AS start, l_orderkey * 40 + l_linenumber * 7 + l_quantity::BIGINT AS stop,
  's' || (l_partkey % 6) AS sample_id, CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS strand, l_orderkey, l_linenumber FROM lineitem)"""
REG = """reg AS (SELECT p_partkey AS region_id, 'c' || (p_partkey % 8) AS chr, p_partkey * 200 AS start, p_partkey * 200 + p_size * 10 AS stop,
  CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)"""
CNT = """cnt AS (SELECT p_brand || '|' || p_type AS feature_id, 's' || (l_suppkey % 12) AS sample_id, sum(l_quantity::BIGINT)::BIGINT AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
SAM = """sam AS (SELECT 's' || k AS sample_id, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS grp, k % 3 AS batch, k // 2 AS bio_rep FROM range(12) t(k))"""
EXPR = """expr AS (SELECT event_type || json_extract_string(props, '$.k') AS gene, user_id AS cell, count(*)::BIGINT AS counts FROM events GROUP BY 1, 2),
cel AS (SELECT user_id AS cell, 'k' || (user_id % 4) AS cluster, 's' || (user_id % 6) AS sample_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 't' || (user_id % 3) END AS label FROM events GROUP BY 1)"""
LOGX = """tot AS (SELECT cell, sum(counts) AS t FROM expr GROUP BY 1),
lx AS (SELECT gene, expr.cell, counts, log2(counts / (t / (SELECT avg(t) FROM tot)) + 1) AS logcounts FROM expr JOIN tot USING (cell))"""
DE = """de AS (SELECT p_brand || '|' || p_type AS feature_id, 'y' || (year(l_shipdate) % 4) AS comparison, round_even(avg(l_discount) * 100 - 5, 6) + 0.0 AS "log2FoldChange",
  (count(*) % 97) / 97.0 AS pvalue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
EDIT = """ed AS (SELECT 'c' || (l_suppkey % 8) AS region, l_partkey % 500 AS position, substr('ACGT', ((l_partkey % 500) % 4 + 1)::INT, 1) AS reference, 's' || (l_suppkey % 3) AS sample_id,
  substr('ACGT', (CASE WHEN l_quantity > 40 THEN (l_linenumber + l_partkey) % 4 ELSE (l_partkey % 500) % 4 END + 1)::INT, 1) AS base FROM lineitem)"""
SITE = """site AS (SELECT *, count_A + count_C + count_G + count_T AS coverage FROM (
  SELECT region, position, reference, sample_id, count(*) FILTER (base = 'A') AS count_A, count(*) FILTER (base = 'C') AS count_C,
    count(*) FILTER (base = 'G') AS count_G, count(*) FILTER (base = 'T') AS count_T FROM ed GROUP BY ALL))"""
SEQS = "sq AS (SELECT doc_id AS id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTNACGTACGTACGTA') AS seq FROM documents)"


def fragments(spark, d):
    start = F.col("l_orderkey") * 40 + F.col("l_linenumber") * 7
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_suppkey") % 8).alias("chr"), start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("stop"),
        F.concat(F.lit("s"), F.col("l_partkey") % 6).alias("sample_id"), F.when(F.col("l_returnflag") == "A", "+").otherwise("-").alias("strand"), "l_orderkey", "l_linenumber",
    )


def regions(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("region_id"), F.concat(F.lit("c"), k % 8).alias("chr"), (k * 200).alias("start"), (k * 200 + F.col("p_size") * 10).alias("stop"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


def counts(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.concat("p_brand", F.lit("|"), "p_type").alias("feature_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 12).alias("sample_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))


def samples(spark):
    k = F.col("id")
    return spark.range(12).select(F.concat(F.lit("s"), k).alias("sample_id"), F.when(k % 2 == 0, "a").otherwise("b").alias("grp"), (k % 3).alias("batch"), F.floor(k / 2).alias("bio_rep"))


def expression(spark, d):
    return table(spark, d, "events").groupBy(F.concat("event_type", F.get_json_object("props", "$.k")).alias("gene"), F.col("user_id").alias("cell")).agg(F.count(F.lit(1)).alias("counts"))


def cell_table(spark, d):
    u = F.col("cell")
    c = table(spark, d, "events").select(F.col("user_id").alias("cell")).distinct()
    return c.select("cell", F.concat(F.lit("k"), u % 4).alias("cluster"), F.concat(F.lit("s"), u % 6).alias("sample_id"), F.when(u % 7 != 0, F.concat(F.lit("t"), u % 3)).alias("label"))


def results(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = li.groupBy(F.concat("p_brand", F.lit("|"), "p_type").alias("feature_id"), F.concat(F.lit("y"), F.year("l_shipdate") % 4).alias("comparison"))
    return g.agg((F.bround(F.avg("l_discount") * 100 - 5, 6) + 0.0).alias("log2FoldChange"), ((F.count(F.lit(1)) % 97) / F.lit(97.0)).alias("pvalue"))


def edits(spark, d):
    p = F.col("l_partkey") % 500
    letter = lambda k: F.substring(F.lit("ACGT"), (k + 1).cast("int"), F.lit(1))
    other = F.when(F.col("l_quantity") > 40, (F.col("l_linenumber") + F.col("l_partkey")) % 4).otherwise(p % 4)
    return table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 8).alias("region"), p.alias("position"), letter(p % 4).alias("reference"), F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("sample_id"), letter(other).alias("base"))


def sites(spark, d):
    x = edits(spark, d)
    n = [F.count_if(F.col("base") == b).alias(f"count_{b}") for b in "ACGT"]
    return x.groupBy("region", "position", "reference", "sample_id").agg(*n).withColumn("coverage", F.expr("count_A + count_C + count_G + count_T"))


def sequences(spark, d):
    s = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTNACGTACGTACGTA")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), s.alias("seq"))


def r6(c):
    return F.bround(c, 6)


# --- intervals ------------------------------------------------------------------------------------------------

ISL = """, prev AS (SELECT *, max(stop) OVER (PARTITION BY chr ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {src}),
isl AS (SELECT *, sum(CASE WHEN p IS NULL OR start > p + {dist} THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, stop) AS island FROM prev)"""


@query(f"WITH {FRAG}{ISL.format(src='frag', dist=0)} SELECT chr, min(start) AS start, max(stop) AS stop, count(*) AS n_fragments, count(DISTINCT sample_id) AS n_samples, max(stop) - min(start) AS width FROM isl GROUP BY chr, island HAVING count(DISTINCT sample_id) >= 2")
def islands_consensus(spark, d):
    return I.consensus(fragments(spark, d), 2)


@query(f"WITH {FRAG}, wide AS (SELECT chr, greatest(0, start - 20) AS start, least(500000, stop + 20) AS stop, sample_id FROM frag WHERE greatest(0, start - 20) < least(500000, stop + 20)){ISL.format(src='wide', dist=5)} SELECT chr, min(start) AS start, max(stop) AS stop, count(*) AS n_fragments FROM isl GROUP BY chr, island HAVING count(*) >= 3")
def islands_merge_fragments(spark, d):
    sizes = spark.range(8).select(F.concat(F.lit("c"), "id").alias("chr"), F.lit(500000).alias("size"))
    return I.merge(I.expand(fragments(spark, d), 20, 20, sizes), 5, [F.count(F.lit(1)).alias("n_fragments")]).where("n_fragments >= 3")


@query(f"WITH {FRAG}{ISL.format(src='frag', dist=0)}, m AS (SELECT chr, min(start) AS start, max(stop) AS stop, count(*) AS n_fragments, count(DISTINCT sample_id) AS n_samples, max(stop) - min(start) AS width FROM isl GROUP BY chr, island), k AS (SELECT *, n_fragments / width::DOUBLE AS density FROM m WHERE width >= 10 AND n_samples >= 2), q AS (SELECT greatest(0.01, quantile_cont(density, 0.5)) AS c FROM k) SELECT k.* FROM k, q WHERE density >= c")
def regions_select_density(spark, d):
    return I.select_regions(I.consensus(fragments(spark, d), 1), 10, 2, 0.01, 0.5)


@query(f"WITH {REG} SELECT region_id, chr, strand, greatest(0, start - CASE WHEN strand = '-' THEN 20 ELSE 100 END) AS start, least(300000, stop + CASE WHEN strand = '-' THEN 100 ELSE 20 END) AS stop FROM reg WHERE greatest(0, start - CASE WHEN strand = '-' THEN 20 ELSE 100 END) < least(300000, stop + CASE WHEN strand = '-' THEN 100 ELSE 20 END)")
def regions_expand(spark, d):
    sizes = spark.range(8).select(F.concat(F.lit("c"), "id").alias("chr"), F.lit(300000).alias("size"))
    return I.expand(regions(spark, d), 100, 20, sizes, stranded=True)


@query(f"WITH {REG} SELECT region_id, chr, strand, greatest(0, (start + stop) // 2 - 50) AS start, (start + stop) // 2 + 50 AS stop FROM reg")
def regions_center(spark, d):
    return I.center(regions(spark, d), 50)


def _over(cond: str, extra: str = "") -> str:
    return f"WITH {FRAG}, {REG} SELECT region_id, sample_id, count(*) AS value FROM frag f JOIN reg r ON f.chr = r.chr AND {cond}{extra} GROUP BY 1, 2"


@query(_over("f.start < r.stop AND r.start < f.stop"))
def overlap_count(spark, d):
    return I.count_overlaps(regions(spark, d), fragments(spark, d), "region_id", ["sample_id"])


@query(_over("f.start <= r.stop AND r.start <= f.stop"))
def overlap_count_closed(spark, d):
    return I.count_overlaps(regions(spark, d), fragments(spark, d), "region_id", ["sample_id"], closed=True)


@query(_over("f.start < r.stop AND r.start < f.stop", " AND f.strand = r.strand"))
def overlap_stranded(spark, d):
    return I.count_overlaps(regions(spark, d), fragments(spark, d), "region_id", ["sample_id"], stranded=True)


@query(_over("f.start < r.stop AND r.start < f.stop", " AND least(f.stop, r.stop) - greatest(f.start, r.start) >= 10"))
def overlap_min_bp(spark, d):
    return I.count_overlaps(regions(spark, d), fragments(spark, d), "region_id", ["sample_id"], min_overlap=10)


@query(f"WITH {FRAG}, {REG} SELECT chr, start, stop, sample_id, l_orderkey, l_linenumber FROM frag f WHERE NOT EXISTS (SELECT 1 FROM reg r WHERE f.chr = r.chr AND f.start < r.stop AND r.start < f.stop)")
def overlap_anti(spark, d):
    cols = ["chr", "start", "stop", "sample_id", "l_orderkey", "l_linenumber"]
    return I.anti(fragments(spark, d), regions(spark, d), ["chr", "start", "stop"]).select(*cols)


@query(f"WITH {FRAG}, {REG} SELECT chr, start, stop, sample_id, l_orderkey, l_linenumber FROM frag f WHERE EXISTS (SELECT 1 FROM reg r WHERE f.chr = r.chr AND f.start < r.stop AND r.start < f.stop)")
def overlap_semi(spark, d):
    cols = ["chr", "start", "stop", "sample_id", "l_orderkey", "l_linenumber"]
    return I.semi(fragments(spark, d), regions(spark, d), ["chr", "start", "stop"]).select(*cols)


@query(f"WITH {FRAG}, {REG}, x AS (SELECT l_orderkey, l_linenumber, f.start AS start, f.stop AS stop, f.chr AS chr, region_id, greatest(0, r.start - f.stop, f.start - r.stop) AS distance FROM frag f LEFT JOIN reg r ON f.chr = r.chr) SELECT l_orderkey, l_linenumber, chr, start, min(distance) AS distance FROM x GROUP BY l_orderkey, l_linenumber, chr, start, stop")
def nearest_region(spark, d):
    f = fragments(spark, d).dropDuplicates(["l_orderkey", "l_linenumber", "chr", "start", "stop"])
    return I.nearest(f, regions(spark, d), "region_id").select("l_orderkey", "l_linenumber", "chr", "start", "distance")


LINK = f"""WITH {FRAG}, {REG}{ISL.format(src='frag', dist=0)}, pk AS (SELECT chr || ':' || min(start) AS peak_id, chr, min(start) AS start, max(stop) AS stop FROM isl GROUP BY chr, island),
gn AS (SELECT region_id AS gene_id, chr, strand, CASE WHEN strand = '+' THEN start ELSE stop END AS tss, (region_id % 7)::DOUBLE AS lfc FROM reg),
lk AS (SELECT gene_id, peak_id, gn.chr AS chr, round_even(CASE WHEN strand = '-' THEN tss - (start + 1 + stop) / 2.0 ELSE (start + 1 + stop) / 2.0 - tss END, 0)::BIGINT AS distance_to_tss, lfc
  FROM gn JOIN pk ON gn.chr = pk.chr AND start + 1 <= tss + 500 AND stop >= greatest(1, tss - 500)),
lf AS (SELECT *, abs(distance_to_tss) AS abs_distance FROM lk)"""


def _link_parts(spark, d):
    genes = regions(spark, d).select(F.col("region_id").alias("gene_id"), "chr", "strand", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("stop")).alias("tss"), (F.col("region_id") % 7).cast("double").alias("lfc"))
    peaks = I.merge(fragments(spark, d)).select(F.concat("chr", F.lit(":"), "start").alias("peak_id"), "chr", "start", "stop")
    return genes, peaks, I.within(genes, peaks, 500)


@query(f"{LINK} SELECT * FROM lf")
def link_within_distance(spark, d):
    return _link_parts(spark, d)[2]


@query(f"{LINK}, g AS (SELECT gene_id, count(*) AS n, min(abs_distance) AS m FROM lf GROUP BY 1) SELECT gn.*, n IS NOT NULL AS has_peak, coalesce(n, 0) AS n_peaks, m AS nearest_peak_distance FROM gn LEFT JOIN g USING (gene_id)")
def link_gene_summary(spark, d):
    genes, _, links = _link_parts(spark, d)
    return I.gene_links(genes, links)


@query(f"{LINK}, g AS (SELECT peak_id, gene_id, abs_distance, count(*) OVER (PARTITION BY peak_id) AS n FROM lf QUALIFY row_number() OVER (PARTITION BY peak_id ORDER BY abs_distance, gene_id) = 1) SELECT pk.*, n IS NOT NULL AS near_gene, coalesce(n, 0) AS n_genes, gene_id AS nearest_gene, abs_distance AS nearest_gene_distance FROM pk LEFT JOIN g USING (peak_id)")
def link_peak_summary(spark, d):
    _, peaks, links = _link_parts(spark, d)
    return I.peak_links(peaks, links)


COV = f"""WITH {FRAG}, ev AS (SELECT chr, pos, sum(d) AS d FROM (SELECT chr, start AS pos, 1 AS d FROM frag UNION ALL SELECT chr, stop, -1 FROM frag) GROUP BY ALL HAVING sum(d) <> 0),
st AS (SELECT chr, pos AS start, lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS stop, sum(d) OVER (PARTITION BY chr ORDER BY pos) AS depth FROM ev), cov AS (SELECT chr, start, stop, depth::BIGINT AS depth FROM st WHERE depth > 0)"""


@query(f"{COV} SELECT * FROM cov")
def coverage_steps(spark, d):
    return I.coverage(fragments(spark, d))


BLK = f"{COV}{ISL.format(src='cov', dist=0)}, blk AS (SELECT chr, min(start) AS start, max(stop) AS stop, sum((stop - start) * depth)::BIGINT AS total_signal, max(depth) AS max_signal FROM isl GROUP BY chr, island)"


@query(f"{BLK}, q AS (SELECT quantile_cont(total_signal, 0.99) AS c FROM blk) SELECT blk.* FROM blk, q WHERE total_signal >= c")
def coverage_blocks_top(spark, d):
    b = I.coverage_blocks(I.coverage(fragments(spark, d)))
    cut = b.agg(F.percentile("total_signal", 0.99).alias("c"))
    return b.crossJoin(F.broadcast(cut)).where("total_signal >= c").drop("c")


@query(f"{COV}, e AS (SELECT chr, start, stop, depth, unnest(range(start // 1000, (stop - 1) // 1000 + 1)) AS k FROM cov), n AS (SELECT count(*) AS n FROM frag) SELECT chr, k * 1000 AS start, (k + 1) * 1000 AS stop, round_even(sum((least(stop, (k + 1) * 1000) - greatest(start, k * 1000)) * depth) / 1000.0 * 1e6 / any_value(n), 6) AS cpm FROM e, n GROUP BY chr, k")
def coverage_bins_cpm(spark, d):
    f = fragments(spark, d)
    n = f.agg(F.count(F.lit(1)).alias("n"))
    b = I.bin_average(I.coverage(f), 1000).crossJoin(F.broadcast(n))
    return b.select("chr", "start", "stop", r6(F.col("score") * 1e6 / F.col("n")).alias("cpm"))


@query(f"WITH {FRAG}, e AS (SELECT chr, unnest(range(start // 5000, (stop - 1) // 5000 + 1)) AS k FROM frag), g AS (SELECT chr, k, count(*) AS n FROM e GROUP BY ALL), q AS (SELECT avg(n) + 3 * stddev_samp(n) AS c FROM g) SELECT chr, k * 5000 AS start, (k + 1) * 5000 AS stop, n, round_even(least(n, c), 6) AS capped FROM g, q")
def bin_counts_capped(spark, d):
    return I.bin_counts(fragments(spark, d), 5000, 3.0).withColumn("capped", r6(F.col("capped")))


SETS = f"""WITH {FRAG}, {REG}, ev AS (SELECT chr, pos, sum(x) AS x, sum(y) AS y FROM (SELECT chr, start AS pos, 1 AS x, 0 AS y FROM frag UNION ALL SELECT chr, stop, -1, 0 FROM frag UNION ALL SELECT chr, start, 0, 1 FROM reg UNION ALL SELECT chr, stop, 0, -1 FROM reg) GROUP BY ALL),
cov AS (SELECT * FROM (SELECT chr, pos AS start, lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS stop, sum(x) OVER (PARTITION BY chr ORDER BY pos) AS a, sum(y) OVER (PARTITION BY chr ORDER BY pos) AS b FROM ev) WHERE stop IS NOT NULL AND {{cond}}){ISL.format(src='cov', dist=0)}
SELECT chr, min(start) AS start, max(stop) AS stop FROM isl GROUP BY chr, island"""


@query(SETS.format(cond="a > 0 AND b > 0"))
def interval_intersect(spark, d):
    return I.set_algebra(fragments(spark, d), regions(spark, d), "intersect")


@query(SETS.format(cond="a > 0 AND b = 0"))
def interval_subtract(spark, d):
    return I.set_algebra(fragments(spark, d), regions(spark, d), "subtract")


@query(SETS.format(cond="(a > 0 OR b > 0)"))
def interval_union(spark, d):
    return I.set_algebra(fragments(spark, d), regions(spark, d), "union")


@query(f"WITH {FRAG}, {REG} SELECT floor((CASE WHEN r.strand = '-' THEN pos - f.start ELSE f.start - pos END) / 100.0)::BIGINT AS bin, count(*) AS n FROM frag f JOIN (SELECT *, CASE WHEN strand = '+' THEN start ELSE stop END AS pos FROM reg) r ON f.chr = r.chr AND f.start BETWEEN greatest(0, pos - 1000) AND pos + 1000 GROUP BY 1")
def tss_profile(spark, d):
    p = regions(spark, d).select("chr", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("stop")).alias("pos"), "strand")
    return I.profile(p, fragments(spark, d), 1000, 100)


PAIR = """pr AS (SELECT 'c' || (o_custkey % 8) AS chr, o_orderkey * 3 % 1000 AS start1, o_orderkey * 3 % 1000 + o_orderkey % 5 AS stop1, o_orderkey * 3 % 1000 + o_custkey % 50 AS start2, o_orderkey * 3 % 1000 + o_custkey % 50 + o_orderkey % 4 AS stop2,
  CASE WHEN o_orderkey % 3 = 0 THEN '+' ELSE '-' END AS strand, o_orderkey::VARCHAR AS name FROM orders WHERE o_custkey % 8 = o_orderkey % 8)"""


@query(f"""WITH {PAIR}, e AS (SELECT chr, name, strand, least(start1, start2) AS a, greatest(stop1, stop2) AS b FROM pr), m AS (SELECT chr, name, strand,
CASE WHEN strand = '+' THEN a + 4 WHEN a >= 5 THEN a - 5 ELSE 0 END AS start, CASE WHEN strand = '+' THEN b + 4 WHEN b >= 5 THEN b - 5 ELSE 0 END AS stop FROM e) SELECT * FROM m WHERE stop > start""")
def bedpe_fragments(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    s = k * 3 % 1000
    m = s + F.col("o_custkey") % 50
    p = o.select(F.concat(F.lit("c"), F.col("o_custkey") % 8).alias("chr1"), s.alias("start1"), (s + k % 5).alias("stop1"), F.concat(F.lit("c"), k % 8).alias("chr2"), m.alias("start2"), (m + k % 4).alias("stop2"), k.cast("string").alias("name"), F.when(k % 3 == 0, "+").otherwise("-").alias("strand1"))
    return I.shift_fragments(p)


@query(f"WITH {FRAG}, {REG}{ISL.format(src='frag', dist=0)}, pk AS (SELECT chr || ':' || min(start) AS peak_id, chr, min(start) AS start, max(stop) AS stop FROM isl GROUP BY chr, island), ft AS (SELECT chr, start, stop, 'exon' AS kind FROM reg UNION ALL SELECT chr, greatest(0, start - 500), start, 'promoter' FROM reg), b AS (SELECT peak_id, min(CASE kind WHEN 'promoter' THEN 1 ELSE 2 END) AS r FROM pk JOIN ft ON pk.chr = ft.chr AND pk.start < ft.stop AND ft.start < pk.stop GROUP BY 1) SELECT peak_id, chr, start, stop, CASE r WHEN 1 THEN 'promoter' WHEN 2 THEN 'exon' ELSE 'intergenic' END AS annotation FROM pk LEFT JOIN b USING (peak_id)")
def annotate_priority(spark, d):
    peaks = I.merge(fragments(spark, d)).select(F.concat("chr", F.lit(":"), "start").alias("peak_id"), "chr", "start", "stop")
    r = regions(spark, d)
    f = r.select("chr", "start", "stop", F.lit("exon").alias("kind")).unionAll(r.select("chr", F.greatest(F.lit(0), F.col("start") - 500), "start", F.lit("promoter")))
    return I.annotate_priority(peaks, f, ["promoter", "exon"])


@query("SELECT p_brand AS gene_id, sum(abs(p_size * 10))::BIGINT AS exon_span FROM part GROUP BY 1")
def exon_span(spark, d):
    p = table(spark, d, "part")
    return I.exon_span(p.select(F.col("p_brand").alias("gene_id"), (F.col("p_partkey") * 200).alias("start"), (F.col("p_partkey") * 200 + F.col("p_size") * 10).alias("stop")))


# --- values ---------------------------------------------------------------------------------------------------


@query(f"WITH {CNT} SELECT f.feature_id, s.sample_id, coalesce(value, 0)::BIGINT AS value FROM (SELECT DISTINCT feature_id FROM cnt) f CROSS JOIN (SELECT DISTINCT sample_id FROM cnt) s LEFT JOIN cnt USING (feature_id, sample_id)")
def matrix_outer(spark, d):
    return V.combine(counts(spark, d), "outer")


@query(f"WITH {CNT} SELECT * FROM cnt WHERE feature_id IN (SELECT feature_id FROM cnt GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM cnt))")
def matrix_inner(spark, d):
    return V.combine(counts(spark, d), "inner")


@query(f"WITH {CNT} SELECT * FROM cnt WHERE feature_id IN (SELECT feature_id FROM cnt GROUP BY 1 HAVING count(*) FILTER (value >= 700) >= 8)")
def filter_low_counts(spark, d):
    return V.filter_low(counts(spark, d), 700, 8)


@query(f"WITH {CNT}, {SAM} SELECT * FROM cnt WHERE sample_id IN (SELECT sample_id FROM sam WHERE grp = 'a' AND batch IN (0, 1))")
def filter_metadata(spark, d):
    return V.filter_samples(counts(spark, d), samples(spark), grp=["a"], batch=[0, 1])


@query(f"WITH {CNT} SELECT sample_id FROM cnt WHERE value > 1000 INTERSECT SELECT sample_id FROM cnt WHERE feature_id LIKE 'Brand#1|%'")
def match_samples(spark, d):
    c = counts(spark, d)
    return V.match_samples(c.where("value > 1000"), c.where("feature_id LIKE 'Brand#1|%'"))


@query(f"WITH {CNT}, {SAM} SELECT feature_id, bio_rep, round_even(avg(value), 6) AS value, count(*) AS n_replicates FROM cnt JOIN sam USING (sample_id) GROUP BY 1, 2")
def average_tech_reps_mean(spark, d):
    return V.average_replicates(counts(spark, d), samples(spark), ["bio_rep"]).withColumn("value", r6(F.col("value")))


@query(f"WITH {CNT}, {SAM} SELECT feature_id, batch, median(value)::DOUBLE AS value, count(*) AS n_replicates FROM cnt JOIN sam USING (sample_id) GROUP BY 1, 2")
def average_tech_reps_median(spark, d):
    return V.average_replicates(counts(spark, d), samples(spark), ["batch"], "median")


VAR = f"WITH {CNT}, v AS (SELECT feature_id, round_even(var_samp(value), 6) AS variance FROM cnt GROUP BY 1)"


def _var(df):
    return df.withColumn("variance", r6(F.col("variance")))


@query(f"{VAR} SELECT * FROM v ORDER BY variance DESC NULLS LAST, feature_id LIMIT 20")
def top_variable(spark, d):
    return _var(V.by_variance(counts(spark, d), top=20))


@query(f"{VAR} SELECT * FROM v WHERE variance > 40000")
def low_variance(spark, d):
    return _var(V.by_variance(counts(spark, d), above=40000))


@query(f"{VAR} SELECT v.* FROM v, (SELECT quantile_cont(variance, 0.25) AS c FROM v) WHERE variance > c")
def drop_least_variable(spark, d):
    return _var(V.by_variance(counts(spark, d), drop_share=0.25))


@query(f"WITH {CNT}, {SAM}, v AS (SELECT grp, feature_id, var_samp(value) AS variance FROM cnt JOIN sam USING (sample_id) GROUP BY 1, 2) SELECT feature_id FROM v WHERE variance > 30000 GROUP BY 1 HAVING count(*) = 2")
def shared_variance(spark, d):
    return V.shared_variance(counts(spark, d).join(samples(spark), "sample_id").withColumnRenamed("grp", "view"), 30000)


@query("WITH f AS (SELECT l_suppkey AS s, l_linenumber AS l, max(l_quantity) AS m, min(l_quantity) AS n FROM lineitem GROUP BY 1, 2) SELECT s::VARCHAR AS feature_id, var_samp(m) AS variance FROM f GROUP BY 1 HAVING var_samp(m) = 0")
def zero_variance(spark, d):
    f = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("value"))
    return V.variance(f.select(F.col("l_suppkey").cast("string").alias("feature_id"), "value")).where("variance = 0")


@query(f"WITH {CNT}, g AS (SELECT feature_id, lead(value) OVER (PARTITION BY feature_id ORDER BY value, sample_id) - value AS gap FROM cnt) SELECT feature_id, min(gap) AS least_gap FROM g GROUP BY 1 HAVING min(gap) <= 2")
def pairwise_identical(spark, d):
    return V.pairwise_identical(counts(spark, d), 2)


@query(f"WITH {CNT} SELECT feature_id, sample_id, round_even((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS value FROM cnt WINDOW w AS (PARTITION BY feature_id)")
def scale_zscore(spark, d):
    return V.scale(counts(spark, d)).withColumn("value", r6(F.col("value")))


@query(f"WITH {CNT} SELECT feature_id, sample_id, round_even((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0)::DOUBLE, 6) AS value FROM cnt WINDOW w AS (PARTITION BY feature_id)")
def scale_minmax(spark, d):
    return V.scale(counts(spark, d), "minmax").withColumn("value", r6(F.col("value")))


ROB = "rb AS (SELECT 'f' || (l_partkey % 40) AS feature_id, 's' || l_orderkey || '_' || l_linenumber AS sample_id, CASE WHEN l_partkey % 40 < 10 THEN 7 WHEN l_partkey % 40 < 25 THEN greatest(l_quantity - 45, 0) ELSE l_quantity END::DOUBLE AS value FROM lineitem)"


@query(f"""WITH {ROB}, q AS (SELECT feature_id, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, var_samp(value) AS v FROM rb GROUP BY 1), a AS (SELECT feature_id, median(abs(value - m)) * 1.4826 AS mad FROM rb JOIN q USING (feature_id) GROUP BY 1)
SELECT feature_id, sample_id, round_even(CASE WHEN v IS NULL OR v = 0 THEN 0 WHEN iqr <> 0 THEN (value - m) / iqr WHEN mad <> 0 THEN (value - m) / mad ELSE value - m END, 6) + 0.0 AS value FROM rb JOIN q USING (feature_id) JOIN a USING (feature_id)""")
def scale_robust(spark, d):
    k = F.col("l_partkey") % 40
    v = F.when(k < 10, 7).when(k < 25, F.greatest(F.col("l_quantity") - 45, F.lit(0))).otherwise(F.col("l_quantity")).cast("double")
    x = table(spark, d, "lineitem").select(F.concat(F.lit("f"), k).alias("feature_id"), F.concat(F.lit("s"), "l_orderkey", F.lit("_"), "l_linenumber").alias("sample_id"), v.alias("value"))
    return V.scale(x, "robust").withColumn("value", r6(F.col("value")) + 0.0)


@query(f"WITH {CNT}, m AS (SELECT sample_id, median(value) AS m FROM cnt GROUP BY 1) SELECT feature_id, sample_id, round_even(value - m + (SELECT avg(m) FROM m), 6) AS value FROM cnt JOIN m USING (sample_id)")
def median_centre(spark, d):
    return V.median_centre(counts(spark, d)).withColumn("value", r6(F.col("value")))


@query(f"WITH {CNT} SELECT sample_id, sum(value)::BIGINT AS library_size, count(*) FILTER (value > 0) AS n_detected FROM cnt GROUP BY 1")
def library_sizes(spark, d):
    return V.library_sizes(counts(spark, d))


@query(f"WITH {CNT}, l AS (SELECT sample_id, sum(value) AS t FROM cnt GROUP BY 1) SELECT feature_id, sample_id, round_even(log2(value / t * 1e6 + 1), 6) AS value FROM cnt JOIN l USING (sample_id)")
def log2_cpm(spark, d):
    return V.log2_cpm(counts(spark, d)).withColumn("value", r6(F.col("value")))


@query(f"WITH {CNT}, g AS (SELECT feature_id, avg(ln(value)) AS g FROM cnt WHERE value > 0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM cnt)) SELECT sample_id, round_even(exp(median(ln(value) - g)), 6) AS size_factor FROM cnt JOIN g USING (feature_id) GROUP BY 1")
def size_factors(spark, d):
    return V.size_factors(counts(spark, d)).withColumn("size_factor", r6(F.col("size_factor")))


@query("WITH s AS (SELECT s_name AS sample_id, greatest(0, floor(s_acctbal))::BIGINT AS spikein_reads FROM supplier) SELECT sample_id, spikein_reads, round_even((SELECT min(spikein_reads) FROM s WHERE spikein_reads > 0) / nullif(spikein_reads, 0)::DOUBLE, 6) AS scale_factor FROM s")
def spike_in_factors(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("sample_id"), F.greatest(F.lit(0), F.floor("s_acctbal")).cast("bigint").alias("spikein_reads"))
    return V.spike_in_factors(s).withColumn("scale_factor", r6(F.col("scale_factor")))


@query("SELECT p_brand AS gene_id, 's' || (l_suppkey % 4) AS sample_id, sum(l_quantity::BIGINT)::BIGINT AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 10 <> 3 GROUP BY 1, 2")
def tx_to_gene(spark, d):
    v = table(spark, d, "lineitem").select(F.concat(F.lit("T"), "l_partkey", F.lit("."), "l_linenumber").alias("feature_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("sample_id"), F.col("l_quantity").cast("bigint").alias("value"))
    m = table(spark, d, "part").where("p_partkey % 10 <> 3").select(F.concat(F.lit("T"), "p_partkey", F.lit(".1")).alias("transcript_id"), F.concat("p_brand", F.lit(".12")).alias("gene_id"))
    return V.to_genes(v, m)


@query("SELECT 's' || (l_suppkey % 5) AS sample_id, round_even(avg(CASE WHEN l_quantity > 45 THEN 1.0 ELSE 0 END), 6) AS missing, count(*) AS n FROM lineitem GROUP BY 1")
def missing_share(spark, d):
    v = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("sample_id"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("value"))
    return V.missing_share(v, "sample_id").withColumn("missing", r6(F.col("missing")))


@query(f"WITH {CNT}, x AS (SELECT feature_id, sample_id, CASE WHEN value % 7 > 0 THEN value::DOUBLE END AS value FROM cnt) SELECT feature_id, sample_id, coalesce(value, median(value) OVER (PARTITION BY feature_id)) AS value FROM x")
def impute_median(spark, d):
    c = counts(spark, d).withColumn("value", F.when(F.col("value") % 7 > 0, F.col("value").cast("double")))
    return V.impute(c)


@query(f"WITH {CNT} SELECT feature_id, " + ", ".join(f"max(CASE WHEN sample_id = 's{k}' THEN value END) AS s{k}" for k in range(4)) + " FROM cnt GROUP BY 1")
def matrix_wide(spark, d):
    c = counts(spark, d)
    names = [f"s{k}" for k in range(4)]
    return V.combine(c, "outer").select("feature_id").distinct().join(V.wide(c.where(F.col("sample_id").isin(names)), names), "feature_id", "left")


@query("SELECT c_custkey, unnest(['nation', 'balance']) AS sample_id, unnest([CASE WHEN c_nationkey > 0 THEN round_even(log2(c_nationkey), 6) END, CASE WHEN c_acctbal > 0 THEN round_even(log2(c_acctbal), 6) END]) AS value FROM customer")
def intensity_log2(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"), F.col("c_acctbal").alias("balance"))
    return V.intensities(c, "c_custkey", ["nation", "balance"]).withColumn("value", r6(F.col("value")))


# --- differential results, sets and activity -------------------------------------------------------------------

SIG = 'pvalue <= 0.3 AND abs("log2FoldChange") >= 0.05'
CUTS = {"p": "pvalue", "p_cut": 0.3, "lfc_cut": 0.05}


@query(f"WITH {DE} SELECT feature_id, count(DISTINCT comparison) AS n_comparisons FROM de WHERE {SIG} GROUP BY 1")
def de_select_union(spark, d):
    return X.select(results(spark, d), "union", **CUTS)


@query(f"WITH {DE} SELECT feature_id, count(DISTINCT comparison) AS n_comparisons FROM de WHERE pvalue <= 0.9 GROUP BY 1 HAVING count(DISTINCT comparison) = (SELECT count(DISTINCT comparison) FROM de)")
def de_select_intersect(spark, d):
    return X.select(results(spark, d), "intersect", p="pvalue", p_cut=0.9, lfc_cut=0.0)


@query(f'WITH {DE}, hit AS (SELECT DISTINCT feature_id FROM de WHERE comparison IN (\'y0\', \'y1\', \'y2\') AND pvalue < 0.2 AND abs("log2FoldChange") >= 0.05) SELECT feature_id, ' + ", ".join(f"max(CASE WHEN comparison = 'y{k}' THEN \"log2FoldChange\" END) AS y{k}_lfc, max(CASE WHEN comparison = 'y{k}' THEN pvalue END) AS y{k}_padj" for k in range(3)) + " FROM de JOIN hit USING (feature_id) GROUP BY 1")
def de_comparison_table(spark, d):
    return X.comparison_table(results(spark, d).withColumnRenamed("pvalue", "padj"), ["y0", "y1", "y2"], p_cut=0.2, lfc_cut=0.05, needs_hits=False)


@query(f'WITH {DE} SELECT comparison, count(*) FILTER ({SIG} AND "log2FoldChange" > 0) AS n_up, count(*) FILTER ({SIG} AND "log2FoldChange" < 0) AS n_down, round_even(avg("log2FoldChange"), 6) AS mean_lfc, round_even(median("log2FoldChange"), 6) AS median_lfc FROM de GROUP BY 1')
def direction_counts(spark, d):
    return X.direction_counts(results(spark, d), **CUTS).withColumns({"mean_lfc": r6(F.col("mean_lfc")), "median_lfc": r6(F.col("median_lfc"))})


@query(f"""WITH {CNT}, {SAM}, g AS (SELECT feature_id, avg(value) FILTER (grp = 'a') AS mean_a, avg(value) FILTER (grp = 'b') AS mean_b FROM cnt JOIN sam USING (sample_id) GROUP BY 1) SELECT feature_id, round_even(mean_a, 6) AS mean_a, round_even(mean_b, 6) AS mean_b, round_even(log2((mean_b + 1) / (mean_a + 1)), 6) AS "log2FoldChange" FROM g""")
def global_shift(spark, d):
    g = X.group_shift(counts(spark, d), samples(spark), "a", "b")
    return g.select("feature_id", *[r6(F.col(c)).alias(c) for c in ("mean_a", "mean_b", "log2FoldChange")])


@query(f"WITH {EXPR}, n AS (SELECT cluster, sample_id, count(*) AS n_cells FROM cel GROUP BY 1, 2 HAVING count(*) >= 5), k AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS k FROM n) SELECT cluster, sample_id, gene, sum(counts)::BIGINT AS counts, any_value(n_cells) AS n_cells FROM expr JOIN cel USING (cell) JOIN k USING (cluster, sample_id) WHERE k >= 2 GROUP BY 1, 2, 3")
def pseudobulk_sum(spark, d):
    return X.pseudobulk(expression(spark, d), cell_table(spark, d), 5, 2)


@query("WITH p AS (SELECT 's' || (p_size % 9) AS sample_id, CASE WHEN p_size % 9 = 0 AND p_type = 'SMALL' THEN NULL ELSE p_type END AS annotation FROM part), g AS (SELECT * FROM (SELECT DISTINCT sample_id FROM p) CROSS JOIN (SELECT DISTINCT annotation FROM p WHERE annotation IS NOT NULL)), c AS (SELECT sample_id, annotation, count(*) AS n FROM p GROUP BY 1, 2) SELECT sample_id, annotation, coalesce(n, 0) AS n, round_even(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY sample_id), 6) AS share FROM g LEFT JOIN c USING (sample_id, annotation)")
def annotation_counts_dense(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_size") % 9).alias("sample_id"), F.when(~((F.col("p_size") % 9 == 0) & (F.col("p_type") == "SMALL")), F.col("p_type")).alias("annotation"))
    return X.annotation_counts(p).withColumn("share", r6(F.col("share")))


def _sets(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat("p_type", F.lit("_"), F.col("p_size") % 5).alias("set_id"), F.col("p_name").alias("gene"), "p_partkey")


@query("WITH s AS (SELECT DISTINCT p_type || '_' || (p_size % 5) AS set_id, 'g' || (p_partkey % 300) AS gene FROM part), u AS (SELECT DISTINCT gene FROM s), h AS (SELECT DISTINCT 'g' || (p_partkey % 300) AS gene FROM part WHERE p_size > 45), g AS (SELECT set_id, count(*) AS set_size, count(h.gene) AS overlap FROM s LEFT JOIN h ON s.gene = h.gene GROUP BY 1), t AS (SELECT (SELECT count(*) FROM h) AS n_hits, (SELECT count(*) FROM u) AS n_universe) SELECT set_id, set_size, overlap, n_hits, n_universe, round_even(overlap * (n_universe - set_size - n_hits + overlap) / ((set_size - overlap) * (n_hits - overlap) + 1e-10), 6) AS odds_ratio FROM g, t WHERE set_size BETWEEN 5 AND 200")
def ora_counts(spark, d):
    p = table(spark, d, "part")
    gene = F.concat(F.lit("g"), F.col("p_partkey") % 300).alias("gene")
    s = p.select(F.concat("p_type", F.lit("_"), F.col("p_size") % 5).alias("set_id"), gene)
    return X.over_representation(s, p.where("p_size > 45").select(gene), s.select("gene").distinct(), 5, 200).withColumn("odds_ratio", r6(F.col("odds_ratio")))


@query(f"""WITH {DE}, r0 AS (SELECT feature_id AS gene, max("log2FoldChange") AS stat FROM de WHERE comparison = 'y0' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY stat DESC, gene) AS rank, count(*) OVER () AS n FROM r0),
s AS (SELECT DISTINCT split_part(feature_id, '|', 2) AS set_id, feature_id AS gene FROM de), x AS (SELECT k.set_id, r.gene, rank, n, s.gene IS NOT NULL AS hit, CASE WHEN s.gene IS NOT NULL THEN abs(stat) ELSE 0 END AS w FROM r CROSS JOIN (SELECT DISTINCT set_id FROM s) k LEFT JOIN s ON s.gene = r.gene AND s.set_id = k.set_id),
y AS (SELECT *, sum(w) OVER (PARTITION BY set_id ORDER BY rank) / sum(w) OVER (PARTITION BY set_id) - count(*) FILTER (NOT hit) OVER (PARTITION BY set_id ORDER BY rank)::DOUBLE / nullif(count(*) FILTER (NOT hit) OVER (PARTITION BY set_id), 0) AS run, count(*) FILTER (hit) OVER (PARTITION BY set_id) AS size FROM x)
SELECT set_id, any_value(size) AS size, round_even(CASE WHEN max(run) >= -min(run) THEN max(run) ELSE min(run) END, 6) AS es FROM y GROUP BY 1""")
def gsea_running_sum(spark, d):
    de = results(spark, d)
    ranked = de.where("comparison = 'y0'").select(F.col("feature_id").alias("gene"), F.col("log2FoldChange").alias("stat"))
    sets = de.select(F.split("feature_id", "\\|")[1].alias("set_id"), F.col("feature_id").alias("gene"))
    return X.gsea(ranked, sets).withColumn("es", r6(F.col("es")))


@query(f"""WITH {DE}, r0 AS (SELECT comparison, feature_id AS gene, max("log2FoldChange") AS stat FROM de GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY stat DESC, gene) AS rank FROM r0),
s AS (SELECT DISTINCT split_part(feature_id, '|', 2) AS set_id, feature_id AS gene FROM de), x AS (SELECT comparison, k.set_id, r.gene, rank, s.gene IS NOT NULL AS hit, CASE WHEN s.gene IS NOT NULL THEN abs(stat) ELSE 0 END AS w FROM r CROSS JOIN (SELECT DISTINCT set_id FROM s) k LEFT JOIN s ON s.gene = r.gene AND s.set_id = k.set_id),
y AS (SELECT *, sum(w) OVER o / sum(w) OVER a - count(*) FILTER (NOT hit) OVER o::DOUBLE / nullif(count(*) FILTER (NOT hit) OVER a, 0) AS run, count(*) FILTER (hit) OVER a AS size FROM x WINDOW o AS (PARTITION BY comparison, set_id ORDER BY rank), a AS (PARTITION BY comparison, set_id))
SELECT comparison, set_id, any_value(size) AS size, round_even(CASE WHEN max(run) >= -min(run) THEN max(run) ELSE min(run) END, 6) AS es FROM y GROUP BY 1, 2""")
def gsea_per_comparison(spark, d):
    de = results(spark, d)
    ranked = de.select("comparison", F.col("feature_id").alias("gene"), F.col("log2FoldChange").alias("stat"))
    sets = de.select(F.split("feature_id", "\\|")[1].alias("set_id"), F.col("feature_id").alias("gene"))
    return X.gsea(ranked, sets, by=["comparison"]).withColumn("es", r6(F.col("es")))


@query("WITH s AS (SELECT DISTINCT p_type || '_' || (p_size % 5) AS set_id, 'g' || (p_partkey % 300) AS gene FROM part), n AS (SELECT set_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.set_id AS x, b.set_id AS y, count(*) AS shared FROM s a JOIN s b ON a.gene = b.gene AND a.set_id < b.set_id GROUP BY 1, 2) SELECT x, y, shared, round_even(shared / (nx.n + ny.n - shared)::DOUBLE, 6) AS jaccard FROM p JOIN n nx ON nx.set_id = x JOIN n ny ON ny.set_id = y")
def set_similarity(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.concat("p_type", F.lit("_"), F.col("p_size") % 5).alias("set_id"), F.concat(F.lit("g"), F.col("p_partkey") % 300).alias("gene"))
    return X.set_similarity(s).withColumn("jaccard", r6(F.col("jaccard")))


NET = f"WITH {CNT}, net AS (SELECT DISTINCT 'tf' || (length(feature_id) % 5) AS source, feature_id AS target, (ascii(substr(feature_id, 7, 1)) % 3 - 1)::DOUBLE AS mor FROM cnt)"


def _net(c):
    f = F.col("feature_id")
    return c.select(F.concat(F.lit("tf"), F.length(f) % 5).alias("source"), f.alias("target"), (F.ascii(F.substring(f, 7, 1)) % 3 - 1).cast("double").alias("mor")).distinct()


@query(f"{NET} SELECT source, sample_id, count(*) AS n_targets, round_even(sum(value * mor), 6) AS score FROM cnt JOIN net ON feature_id = target GROUP BY 1, 2 HAVING count(*) >= 5")
def activity_wsum(spark, d):
    c = counts(spark, d)
    return X.activity(c, _net(c)).withColumn("score", r6(F.col("score")))


@query(f"{NET} SELECT source, sample_id, count(*) AS n_targets, round_even(sum(value * mor) / nullif(sum(abs(mor)), 0), 6) AS score FROM cnt JOIN net ON feature_id = target GROUP BY 1, 2 HAVING count(*) >= 5")
def activity_wmean(spark, d):
    c = counts(spark, d)
    return X.activity(c, _net(c), "wmean").withColumn("score", r6(F.col("score")))


@query(f"{NET}, s AS (SELECT source, count(*) AS k FROM net GROUP BY 1), x AS (SELECT s.source, c.sample_id, value::DOUBLE AS y, coalesce(mor, 0) AS x, mor IS NOT NULL AS hit FROM cnt c CROSS JOIN s LEFT JOIN net ON net.source = s.source AND target = feature_id), r AS (SELECT source, sample_id, count(*) FILTER (hit) AS n_targets, count(*) AS n, corr(y, x) AS r FROM x GROUP BY 1, 2) SELECT source, sample_id, n_targets, round_even(r * sqrt((n - 2) / (1 - r * r)), 4) AS score FROM r WHERE n_targets >= 5")
def activity_ulm(spark, d):
    c = counts(spark, d)
    return X.activity(c, _net(c), "ulm").withColumn("score", F.bround("score", 4))


# --- statistics ------------------------------------------------------------------------------------------------

COR = f"WITH {CNT}, v AS (SELECT sample_id AS variable, feature_id AS item, value FROM cnt), p AS (SELECT a.variable AS x, b.variable AS y, a.value AS u, b.value AS v FROM v a JOIN v b ON a.item = b.item AND a.variable < b.variable)"


def correlation_values(spark, d):
    return counts(spark, d).select(F.col("sample_id").alias("variable"), F.col("feature_id").alias("item"), "value")


@query(f"{COR} SELECT x, y, count(*) AS n, round_even(corr(u, v), 6) AS r FROM p GROUP BY 1, 2 HAVING count(*) >= 3")
def corr_pairs_pearson(spark, d):
    v = counts(spark, d).select(F.col("sample_id").alias("variable"), F.col("feature_id").alias("item"), "value")
    return T.correlation_pairs(v).withColumn("r", r6(F.col("r")))


@query(f"{COR}, q AS (SELECT x, y, rank() OVER (PARTITION BY x, y ORDER BY u) + (count(*) OVER (PARTITION BY x, y, u) - 1) / 2.0 AS u, rank() OVER (PARTITION BY x, y ORDER BY v) + (count(*) OVER (PARTITION BY x, y, v) - 1) / 2.0 AS v FROM p) SELECT x, y, count(*) AS n, round_even(corr(u, v), 6) AS r FROM q GROUP BY 1, 2")
def corr_pairs_spearman(spark, d):
    v = counts(spark, d).select(F.col("sample_id").alias("variable"), F.col("feature_id").alias("item"), "value")
    return T.correlation_pairs(v, "spearman").withColumn("r", r6(F.col("r")))


@query(f"WITH {DE}, r AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY pvalue) AS k, count(*) OVER (PARTITION BY comparison) AS m FROM de) SELECT feature_id, comparison, round_even(least(1, min(pvalue * m / k) OVER (PARTITION BY comparison ORDER BY pvalue DESC, k DESC ROWS UNBOUNDED PRECEDING)), 6) AS padj FROM r QUALIFY true")
def bh_adjust(spark, d):
    return T.bh(results(spark, d), by=["comparison"]).select("feature_id", "comparison", r6(F.col("padj")).alias("padj"))


TEST = f"WITH {CNT}, {SAM}, v AS (SELECT split_part(feature_id, '|', 1) AS brand, grp, batch, value FROM cnt JOIN sam USING (sample_id)), r AS (SELECT *, rank() OVER (PARTITION BY brand ORDER BY value) + (count(*) OVER (PARTITION BY brand, value) - 1) / 2.0 AS r FROM v), t AS (SELECT brand, sum(k * k * k - k) AS ties FROM (SELECT brand, count(*)::DOUBLE AS k FROM v GROUP BY brand, value) GROUP BY 1)"


def _brands(spark, d):
    return counts(spark, d).join(samples(spark), "sample_id").select(F.split("feature_id", "\\|")[0].alias("brand"), "grp", "batch", "value")


@query(f"{TEST}, g AS (SELECT brand, count(*) FILTER (grp = 'a') AS n_a, count(*) FILTER (grp = 'b') AS n_b, sum(r) FILTER (grp = 'a') AS s FROM r GROUP BY 1) SELECT brand, n_a, n_b, s - n_a * (n_a + 1) / 2 AS u, round_even((s - n_a * (n_a + 1) / 2 - n_a * n_b / 2.0) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))), 6) AS z FROM g JOIN t USING (brand)")
def rank_sum_test(spark, d):
    return T.rank_sum(_brands(spark, d), ["brand"]).withColumn("z", r6(F.col("z")))


@query(f"{TEST}, g AS (SELECT brand, batch, sum(r) AS s, count(*) AS m FROM r GROUP BY 1, 2), h AS (SELECT brand, sum(m)::DOUBLE AS n, count(*) AS k, sum(s * s / m) AS q FROM g GROUP BY 1), e AS (SELECT brand, n, k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM h JOIN t USING (brand)) SELECT brand, n::BIGINT AS n, k, round_even(h, 6) AS h, round_even(h / (n - 1), 6) AS epsilon2, round_even((h - k + 1) / (n - k), 6) AS eta2 FROM e")
def kruskal_test(spark, d):
    return T.kruskal(_brands(spark, d), ["brand"], "batch").select("brand", "n", "k", *[r6(F.col(c)).alias(c) for c in ("h", "epsilon2", "eta2")])


@query("WITH v AS (SELECT c_mktsegment AS g, c_acctbal - 4000 AS value FROM customer WHERE c_acctbal <> 4000), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY abs(value)) + (count(*) OVER (PARTITION BY g, abs(value)) - 1) / 2.0 AS r FROM v), t AS (SELECT g, sum(k * k * k - k) AS ties FROM (SELECT g, count(*)::DOUBLE AS k FROM v GROUP BY g, abs(value)) GROUP BY 1), s AS (SELECT g, count(*) AS n, sum(CASE WHEN value > 0 THEN r ELSE 0 END) AS w_plus FROM r GROUP BY 1) SELECT g, n, w_plus, round_even((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48), 6) AS z FROM s JOIN t USING (g)")
def signed_rank_test(spark, d):
    v = table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), (F.col("c_acctbal") - 4000).alias("value"))
    return T.signed_rank(v, ["g"]).withColumn("z", r6(F.col("z")))


@query("WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c) SELECT sum(o)::BIGINT AS n, round_even(sum(o * o / e) - sum(o), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, round_even(sqrt(greatest(sum(o * o / e) - sum(o), 0) / (sum(o) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS cramers_v FROM e")
def chi_square_test(spark, d):
    x = T.chi_square(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return x.select("n", r6(F.col("chi2")).alias("chi2"), "df", r6(F.col("cramers_v")).alias("cramers_v"))


@query(f"{TEST}, g AS (SELECT brand, avg(value) FILTER (grp = 'a') AS ma, avg(value) FILTER (grp = 'b') AS mb, var_samp(value) FILTER (grp = 'a') / count(*) FILTER (grp = 'a') AS sa, var_samp(value) FILTER (grp = 'b') / count(*) FILTER (grp = 'b') AS sb, count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb FROM v GROUP BY 1) SELECT brand, na, nb, round_even(ma - mb, 6) AS diff, round_even((ma - mb) / sqrt(sa + sb), 6) AS t, round_even((sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)), 6) AS df FROM g WHERE na > 1 AND nb > 1")
def welch_test(spark, d):
    return T.welch_t(_brands(spark, d), ["brand"]).select("brand", "na", "nb", *[r6(F.col(c)).alias(c) for c in ("diff", "t", "df")])


@query(f"{TEST}, g AS (SELECT brand, batch, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM v GROUP BY 1, 2), o AS (SELECT brand, sum(n * m) / sum(n) AS g FROM g GROUP BY 1), s AS (SELECT brand, sum(n * (m - o.g) * (m - o.g)) AS sb, sum(n * v) AS sw, count(*) - 1 AS df1, (sum(n) - count(*))::BIGINT AS df2 FROM g JOIN o USING (brand) GROUP BY 1) SELECT brand, round_even(sb / df1 / (sw / df2), 6) AS f, df1, df2, round_even(sb / (sb + sw), 6) AS eta2 FROM s")
def anova_test(spark, d):
    x = T.anova(_brands(spark, d), ["brand"], "batch")
    return x.select("brand", r6(F.col("f")).alias("f"), "df1", "df2", r6(F.col("eta2")).alias("eta2"))


@query("WITH v AS (SELECT c_custkey, c_mktsegment AS g, c_acctbal AS value FROM customer), q AS (SELECT g, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM v GROUP BY 1) SELECT c_custkey, g, value, value < lo - 0.4 * (hi - lo) OR value > hi + 0.4 * (hi - lo) AS outlier FROM v JOIN q USING (g)")
def outliers_iqr(spark, d):
    v = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("value"))
    return T.outliers(v, ["g"], "iqr", 0.4)


@query("WITH v AS (SELECT c_custkey, c_mktsegment AS g, c_acctbal AS value FROM customer), m AS (SELECT g, median(value) AS m FROM v GROUP BY 1), a AS (SELECT g, median(abs(value - m)) AS a FROM v JOIN m USING (g) GROUP BY 1) SELECT c_custkey, g, value, abs(value - m) > 1.8 * a AS outlier FROM v JOIN m USING (g) JOIN a USING (g)")
def outliers_mad(spark, d):
    v = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("value"))
    return T.outliers(v, ["g"], "mad", 1.8)


@query("WITH a AS (SELECT vec_id AS item, r AS run, (vec_id * (r + 3) // 7 + label) % 4 AS cluster FROM embeddings, range(5) t(r)), p AS (SELECT x.item AS item, y.item AS other, count(*) AS n, count(*) FILTER (x.cluster = y.cluster) AS k FROM a x JOIN a y ON x.run = y.run AND x.item <> y.item GROUP BY 1, 2) SELECT item, count(*) AS n_pairs, round_even(avg(k / n), 6) AS consensus FROM p GROUP BY 1")
def item_consensus(spark, d):
    e = table(spark, d, "embeddings").crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "run")))
    a = e.select(F.col("vec_id").alias("item"), "run", ((F.floor(F.col("vec_id") * (F.col("run") + 3) / 7) + F.col("label")) % 4).alias("cluster"))
    return T.item_consensus(a).withColumn("consensus", r6(F.col("consensus")))


@query("WITH a AS (SELECT vec_id AS item, r AS step, (vec_id * (r + 3) // 7 + label) % (r + 2) AS cluster FROM embeddings, range(4) t(r)), t AS (SELECT step, cluster, lead(cluster) OVER w AS \"to\", lead(step) OVER w AS nx FROM a WINDOW w AS (PARTITION BY item ORDER BY step)), g AS (SELECT step, cluster AS \"from\", \"to\", count(*) AS n FROM t WHERE nx IS NOT NULL GROUP BY ALL) SELECT *, round_even(n / sum(n) OVER (PARTITION BY step, \"from\"), 6) AS share FROM g")
def transitions(spark, d):
    e = table(spark, d, "embeddings").crossJoin(F.broadcast(spark.range(4).withColumnRenamed("id", "step")))
    a = e.select(F.col("vec_id").alias("item"), "step", ((F.floor(F.col("vec_id") * (F.col("step") + 3) / 7) + F.col("label")) % (F.col("step") + 2)).alias("cluster"))
    return T.transitions(a).withColumn("share", r6(F.col("share")))


@query("WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT *, round_even(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS row_share FROM c")
def contingency_table(spark, d):
    return T.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("row_share", r6(F.col("row_share")))


@query("SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer QUALIFY rank <= 5")
def top_n_per_group(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return T.top_n(c, ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5)


@query("SELECT a.x AS alpha, b.x AS k, c.x AS method FROM (SELECT unnest([0.1, 0.5]) AS x) a, (SELECT unnest([5, 10, 20]::BIGINT[]) AS x) b, (SELECT unnest(['u', 'v']) AS x) c")
def grid_cross(spark, d):
    rows = [(g["alpha"], g["k"], g["method"]) for g in T.grid(alpha=[0.1, 0.5], k=[5, 10, 20], method=["u", "v"])]
    return spark.createDataFrame(rows, "alpha double, k bigint, method string")


@query(f"WITH {CNT}, v AS (SELECT feature_id, var_samp(value) AS v FROM cnt GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY v DESC, feature_id) AS x, v AS y FROM v), e AS (SELECT min_by(x, x) AS ax, min_by(y, x) AS ay, max_by(x, x) AS bx, max_by(y, x) AS b_y FROM r) SELECT x, round_even(y, 4) AS y, round_even(abs((b_y - ay) * x - (bx - ax) * y + bx * ay - b_y * ax) / sqrt((b_y - ay) ** 2 + (bx - ax) ** 2), 4) AS distance FROM r, e ORDER BY distance DESC, x LIMIT 1")
def variance_elbow(spark, d):
    from pyspark.sql import Window

    v = V.variance(counts(spark, d))
    r = v.select(F.row_number().over(Window.orderBy(F.col("variance").desc(), "feature_id")).cast("bigint").alias("x"), F.col("variance").alias("y"))
    return T.elbow(r).select("x", F.bround("y", 4).alias("y"), F.bround("distance", 4).alias("distance"))


# --- quality control -------------------------------------------------------------------------------------------

MIX = "mx AS (SELECT o_orderkey AS id, o_custkey, CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 9 = 0 THEN ' N/A ' ELSE o_orderpriority END AS priority, 'same' AS fixed FROM orders)"


def _mixed(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), "o_custkey", F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 9 == 0, " N/A ").otherwise(F.col("o_orderpriority")).alias("priority"), F.lit("same").alias("fixed"))


def _mix_sql(c: str, kind: str, expr: str) -> str:
    return f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) AS n, round_even(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END), 6) AS missing, count(DISTINCT v) AS n_distinct, round_even((SELECT max(k) FROM (SELECT count(*) AS k FROM (SELECT {expr} AS v FROM mx) WHERE v IS NOT NULL GROUP BY v)) / count(v)::DOUBLE, 6) AS top_share, count(DISTINCT v) <= 1 AS constant FROM (SELECT {expr} AS v FROM mx)"


@query(f"WITH {MIX} " + " UNION ALL ".join([_mix_sql("o_custkey", "numeric", "o_custkey"), _mix_sql("price", "numeric", "price"), _mix_sql("priority", "text", "nullif(trim(priority), 'N/A')"), _mix_sql("fixed", "text", "fixed")]))
def mixed_qc(spark, d):
    x = Q.profile_columns(Q.normalise_missing(_mixed(spark, d)), "id")
    return x.withColumns({"missing": r6(F.col("missing")), "top_share": r6(F.col("top_share"))})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 OR o_custkey IS NULL")
def duplicate_keys(spark, d):
    return Q.duplicate_keys(table(spark, d, "orders"), "o_custkey")


SHEET = "sh AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END AS file_name, c_mktsegment AS \"group\", 'atac' AS omics, CASE WHEN c_nationkey = 3 THEN 'bam' ELSE 'bed' END AS format, c_nationkey AS bio_rep, c_custkey % 3 AS tech_rep, 1 AS batch FROM customer)"


@query(f"WITH {SHEET}, k AS (SELECT *, omics || '_' || \"group\" || '_' || bio_rep || tech_rep || '_b' || batch AS row_key FROM sh), n AS (SELECT *, count(*) OVER (PARTITION BY row_key) AS n FROM k) SELECT row_key, 'empty' AS rule, 'file_name' AS detail FROM n WHERE trim(file_name) = '' UNION ALL SELECT row_key, 'format', format FROM n WHERE format NOT IN ('peaks', 'bed', 'counts', 'seacr') UNION ALL SELECT row_key, 'duplicate_id', row_key FROM n WHERE n > 1")
def sheet_validation(spark, d):
    c = table(spark, d, "customer")
    s = c.select(F.when(F.col("c_custkey") % 50 == 0, "").otherwise(F.col("c_name")).alias("file_name"), F.col("c_mktsegment").alias("group"), F.lit("atac").alias("omics"), F.when(F.col("c_nationkey") == 3, "bam").otherwise("bed").alias("format"), F.col("c_nationkey").alias("bio_rep"), (F.col("c_custkey") % 3).alias("tech_rep"), F.lit(1).alias("batch"))
    return Q.validate_sheet(s, ["file_name", "group", "omics", "format"])


NPX = "npx AS (SELECT CASE WHEN o_orderkey % 40 = 0 THEN ' ' ELSE 'P' || (o_custkey % 50) END AS \"SampleID\", 'OID' || (o_orderkey % 30) AS \"OlinkID\", o_totalprice / 1000 AS \"NPX\", CASE WHEN (o_orderkey % 30) * (o_custkey % 7) > 60 THEN 'WARN' ELSE 'PASS' END AS \"AssayQC\", CASE WHEN o_custkey % 11 = 0 THEN 'ext_ctrl' ELSE 'assay' END AS \"AssayType\", CASE WHEN o_custkey % 13 = 0 THEN 'CONTROL' ELSE 'SAMPLE' END AS \"SampleType\" FROM orders)"


@query(f"WITH {NPX}, x AS (SELECT * FROM npx WHERE \"AssayType\" = 'assay' AND \"SampleType\" = 'SAMPLE' AND trim(\"SampleID\") <> '') SELECT * FROM x WHERE \"OlinkID\" IN (SELECT \"OlinkID\" FROM x GROUP BY 1 HAVING avg(CASE WHEN \"AssayQC\" IN ('WARN', 'FAIL') THEN 1.0 ELSE 0 END) <= 0.25)")
def npx_filter(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = o.select(F.when(k % 40 == 0, " ").otherwise(F.concat(F.lit("P"), c % 50)).alias("SampleID"), F.concat(F.lit("OID"), k % 30).alias("OlinkID"), (F.col("o_totalprice") / 1000).alias("NPX"), F.when((k % 30) * (c % 7) > 60, "WARN").otherwise("PASS").alias("AssayQC"), F.when(c % 11 == 0, "ext_ctrl").otherwise("assay").alias("AssayType"), F.when(c % 13 == 0, "CONTROL").otherwise("SAMPLE").alias("SampleType"))
    return Q.npx_filter(x)


# --- cells -----------------------------------------------------------------------------------------------------

METR = f"WITH {EXPR}, m AS (SELECT cell, sum(counts)::BIGINT AS sum, count(*) AS detected, round_even(sum(CASE WHEN gene LIKE 'err%' THEN counts ELSE 0 END) * 100.0 / sum(counts), 6) AS pct_err, round_even(log10(count(*)) / CASE WHEN sum(counts) > 1 THEN log10(sum(counts)) END, 6) AS log10_genes_per_umi FROM expr GROUP BY 1)"


def _metrics(spark, d):
    m = C.cell_metrics(expression(spark, d), {"err": "err"})
    return m.withColumns({"pct_err": r6(F.col("pct_err")), "log10_genes_per_umi": r6(F.col("log10_genes_per_umi"))})


@query(f"{METR} SELECT * FROM m")
def cell_qc(spark, d):
    return _metrics(spark, d)


FILT = f"""{METR}, s AS (SELECT median(log2(sum)) AS ms, median(log2(detected)) AS md, median(pct_err) AS mp FROM m), a AS (SELECT median(abs(log2(sum) - ms)) * 1.4826 AS ds, median(abs(log2(detected) - md)) * 1.4826 AS dd, median(abs(pct_err - mp)) * 1.4826 AS dp FROM m, s),
fl AS (SELECT m.*, log2(sum) < ms - 1.5 * ds AS low_lib_size, log2(detected) < md - 1.5 * dd AS low_n_features, pct_err > mp + 1.5 * dp AS high_pct_err, pct_err > 40 AS hard_cap, cell % 11 = 0 AS doublets FROM m, s, a)"""


def _filtered(spark, d):
    m = _metrics(spark, d).withColumn("doublet_class", F.when(F.col("cell") % 11 == 0, "doublet").otherwise("singlet"))
    return C.filter_adaptive(m, "pct_err", 1.5, 40.0, "doublet_class").drop("doublet_class")


@query(f"{FILT} SELECT *, NOT (low_lib_size OR low_n_features OR high_pct_err OR hard_cap OR doublets) AS keep FROM fl")
def cell_filter_mad(spark, d):
    return _filtered(spark, d)


@query(f"{FILT}, k AS (SELECT *, NOT (low_lib_size OR low_n_features OR high_pct_err OR hard_cap OR doublets) AS keep FROM fl) " + " UNION ALL ".join(f"SELECT '{n}' AS reason, count(*) FILTER ({c}) AS n FROM k" for n, c in [("low_lib_size", "low_lib_size"), ("low_n_features", "low_n_features"), ("high_pct_err", "high_pct_err"), ("hard_cap", "hard_cap"), ("doublets", "doublets"), ("discarded", "NOT keep"), ("kept", "keep")]))
def cell_filter_reasons(spark, d):
    return C.filter_reasons(_filtered(spark, d))


@query(f"WITH {EXPR}, {LOGX} SELECT gene, cell, counts, round_even(logcounts, 6) AS logcounts FROM lx")
def log_normalize(spark, d):
    return C.log_normalize(expression(spark, d)).select("gene", "cell", "counts", r6(F.col("logcounts")).alias("logcounts"))


@query(f"WITH {EXPR}, {LOGX}, n AS (SELECT count(*) AS n FROM cel), g AS (SELECT gene, sum(logcounts) / n AS mean, (sum(logcounts * logcounts) - sum(logcounts) * sum(logcounts) / n) / (n - 1) AS variance FROM lx, n GROUP BY gene, n) SELECT gene, round_even(mean, 6) AS mean, round_even(variance, 6) AS variance, round_even(variance / mean, 6) AS dispersion FROM g ORDER BY variance / mean DESC, gene LIMIT 50")
def variable_genes(spark, d):
    n = cell_table(spark, d).agg(F.count(F.lit(1)).alias("n"))
    g = C.variable_genes(C.log_normalize(expression(spark, d)), n, 50)
    return g.select("gene", *[r6(F.col(c)).alias(c) for c in ("mean", "variance", "dispersion")])


DOT = f"WITH {EXPR}, n AS (SELECT cluster, count(*) AS n_cells FROM cel GROUP BY 1), dot AS (SELECT cluster, gene, sum(counts) / any_value(n_cells)::DOUBLE AS mean, count(*) FILTER (counts > 0) / any_value(n_cells)::DOUBLE AS pct FROM expr JOIN cel USING (cell) JOIN n USING (cluster) GROUP BY 1, 2)"


@query(f"{DOT} SELECT cluster, gene, round_even(mean, 6) AS mean, round_even(pct, 6) AS pct FROM dot")
def marker_dotstats(spark, d):
    return C.marker_stats(expression(spark, d), cell_table(spark, d)).withColumns({"mean": r6(F.col("mean")), "pct": r6(F.col("pct"))})


@query(f"{DOT}, r AS (SELECT cluster, gene, round_even(log2((mean + 0.01) / (coalesce((sum(mean) OVER w - mean) / nullif(count(*) OVER w - 1, 0), 0) + 0.01)), 6) AS log2_ratio FROM dot WINDOW w AS (PARTITION BY gene)) SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY log2_ratio DESC, gene)::INT AS rank FROM r QUALIFY rank <= 10")
def cluster_markers(spark, d):
    s = C.marker_stats(expression(spark, d), cell_table(spark, d))
    from pyspark.sql import Window

    m = C.markers(s, 1 << 30).withColumn("log2_ratio", r6(F.col("log2_ratio")))
    w = Window.partitionBy("cluster").orderBy(F.col("log2_ratio").desc(), "gene")
    return m.select("cluster", "gene", "log2_ratio", F.row_number().over(w).alias("rank")).where("rank <= 10")


@query(f"WITH {EXPR}, c AS (SELECT * FROM cel WHERE label IS NOT NULL), u AS (SELECT 'overall' AS grouping, 'all' AS grp, label, count(*) AS n FROM c GROUP BY label UNION ALL SELECT 'cluster', cluster, label, count(*) FROM c GROUP BY cluster, label UNION ALL SELECT 'sample', sample_id, label, count(*) FROM c GROUP BY sample_id, label) SELECT *, round_even(n / sum(n) OVER (PARTITION BY grouping, grp), 6) AS share FROM u")
def label_summary(spark, d):
    return C.label_summary(cell_table(spark, d)).withColumn("share", r6(F.col("share")))


@query(f"WITH {EXPR}, g AS (SELECT * FROM (SELECT DISTINCT sample_id FROM cel) CROSS JOIN (SELECT DISTINCT cluster FROM cel)), c AS (SELECT sample_id, cluster, count(*) AS n FROM cel GROUP BY 1, 2) SELECT sample_id, cluster, coalesce(n, 0) AS n, round_even(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY sample_id), 6) AS share FROM g LEFT JOIN c USING (sample_id, cluster)")
def cell_composition(spark, d):
    return C.composition(cell_table(spark, d)).withColumn("share", r6(F.col("share")))


MK = "mk AS (SELECT DISTINCT 'T' || (length(gene) % 3) AS cell_type, gene, CASE WHEN ascii(right(gene, 1)) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM expr WHERE ascii(right(gene, 1)) % 5 < 3)"


def _marker_table(x):
    last = F.ascii(F.right("gene", F.lit(1)))
    return x.where(last % 5 < 3).select(F.concat(F.lit("T"), F.length("gene") % 3).alias("cell_type"), "gene", F.when(last % 2 == 0, 1).otherwise(-1).alias("sign")).distinct()


@query(f"""WITH {EXPR}, {LOGX}, {MK}, x AS (SELECT g.gene, cel.cell, cluster, coalesce(logcounts, 0) AS v FROM (SELECT DISTINCT gene FROM mk) g CROSS JOIN cel LEFT JOIN lx ON lx.gene = g.gene AND lx.cell = cel.cell),
z AS (SELECT cluster, cell, gene, greatest(-10, least(10, (v - avg(v) OVER w) / greatest(stddev_samp(v) OVER w, 2.220446049250313e-16))) AS z FROM x WINDOW w AS (PARTITION BY gene)),
c AS (SELECT cluster, cell, cell_type, sum(z * sign) / sqrt(count(*)) AS score FROM z JOIN mk USING (gene) GROUP BY 1, 2, 3), r AS (SELECT cluster, cell_type, sum(score) AS score FROM c GROUP BY 1, 2)
SELECT cluster, cell_type, round_even(score, 5) AS score, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, cell_type)::INT AS rank FROM r""")
def sctype_score(spark, d):
    x = C.log_normalize(expression(spark, d))
    s = C.type_scores(x, cell_table(spark, d), _marker_table(x))
    return s.select("cluster", "cell_type", F.bround("score", 5).alias("score"), "rank")


CYTO = f"""WITH {EXPR}, {LOGX}, c AS (SELECT cell, count(*) AS detected FROM expr GROUP BY 1), x AS (SELECT gene, c.cell, detected, coalesce(logcounts, 0) AS v FROM (SELECT DISTINCT gene FROM lx) CROSS JOIN c LEFT JOIN lx USING (gene, cell)),
k AS (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY gene ORDER BY detected) + (count(*) OVER (PARTITION BY gene, detected) - 1) / 2.0 AS rd FROM x),
g AS (SELECT gene, coalesce(corr(rv, rd), 0) AS r FROM k GROUP BY 1)"""


@query(f"{CYTO} SELECT gene, round_even(r, 6) + 0.0 AS r FROM g")
def gene_count_correlation(spark, d):
    return C.gene_count_correlation(C.log_normalize(expression(spark, d))).withColumn("r", r6(F.col("r")) + 0.0)


@query(f"""{CYTO}, b AS (SELECT gene FROM g ORDER BY abs(round(r, 9)) DESC, gene LIMIT 40), raw AS (SELECT cell, sum(CASE WHEN gene IN (SELECT gene FROM b) THEN v ELSE 0 END) / 40 AS raw FROM x GROUP BY 1),
gr AS (SELECT a.cell, b.cell AS other FROM c a JOIN c b ON a.cell % 50 = b.cell % 50 AND a.cell <> b.cell WHERE a.cell % 7 > 0), s AS (SELECT c.cell, coalesce(avg(raw), 0) AS v FROM c LEFT JOIN gr ON gr.cell = c.cell LEFT JOIN raw ON raw.cell = gr.other GROUP BY 1)
SELECT cell, CASE WHEN max(v) OVER () > min(v) OVER () THEN round_even(1 - (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) + 0.0 ELSE 0.5 END AS score FROM s""")
def cytotrace_score(spark, d):
    x = C.log_normalize(expression(spark, d))
    c = x.select("cell").distinct()
    o = c.select(F.col("cell").alias("other"))
    graph = c.join(o, (F.col("cell") % 50 == F.col("other") % 50) & (F.col("cell") != F.col("other"))).where("cell % 7 > 0")
    return C.potency(x, graph, 40).withColumn("score", r6(F.col("score")) + 0.0)


@query("SELECT user_id AS cell, sum(CASE WHEN event_type = 'click' THEN 2 ELSE 1 END)::BIGINT AS spliced, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS unspliced, round_even(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) / sum(CASE WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 2 ELSE 1 END)::DOUBLE, 6) AS unspliced_share FROM events GROUP BY 1")
def velocity_ratio(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("cell"), F.when(F.col("event_type") == "click", 2).otherwise(1).alias("spliced"), F.when(F.col("event_type") == "view", 1).otherwise(0).alias("unspliced"))
    return C.spliced_ratio(e).withColumn("unspliced_share", r6(F.col("unspliced_share")))


# --- graphs ----------------------------------------------------------------------------------------------------

KNN = """WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.id AS id, b.id AS other, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS distance FROM p a JOIN p b ON a.id <> b.id),
knn AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY distance, other)::INT AS rank, other, distance FROM x QUALIFY rank <= 10)"""


def _knn(spark, d, k=10):
    return G.knn(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k)


@query(f"{KNN} SELECT id, rank, other, round_even(distance, 6) AS distance FROM knn")
def knn_exact(spark, d):
    return _knn(spark, d).withColumn("distance", r6(F.col("distance")))


@query(f"{KNN}, o AS (SELECT id, other FROM knn UNION ALL SELECT DISTINCT id, id FROM knn), p2 AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM o x JOIN o y ON x.other = y.other AND x.id < y.id GROUP BY 1, 2) SELECT a, b, shared, round_even(shared / (22.0 - shared), 6) AS weight FROM p2")
def snn_jaccard(spark, d):
    return G.snn(_knn(spark, d)).withColumn("weight", r6(F.col("weight")))


@query(f"{KNN}, h AS (SELECT id, count(*) FILTER (rank <= 5) AS k FROM knn GROUP BY 1) SELECT id, round_even(k / 10.0, 6) AS jaccard FROM h")
def knn_overlap(spark, d):
    k = _knn(spark, d)
    return G.knn_overlap(k, k.where("rank <= 5")).withColumn("jaccard", r6(F.col("jaccard")))


@query("WITH x AS (SELECT label AS cluster, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT cluster, dim::INT AS dim, round_even(avg(v), 6) AS value FROM x GROUP BY 1, 2")
def cluster_centroids(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return G.centroids(p, e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))).withColumn("value", r6(F.col("value")))


@query()
def embedding_pca(spark, d):
    return M.pca(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 5)


# --- editing and sequences ---------------------------------------------------------------------------------------

ALT = """sub AS (SELECT region, position, reference, sample_id, base, count(*) AS n FROM ed WHERE base <> reference GROUP BY ALL),
alt AS (SELECT site.*, s.base AS alt, s.n AS alt_count FROM site LEFT JOIN (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY region, position, reference, sample_id ORDER BY n DESC, base) = 1) s USING (region, position, reference, sample_id))"""


@query(f"WITH {EDIT}, {SITE} SELECT * FROM site")
def editing_sites(spark, d):
    return sites(spark, d)


def _coded(spark, d):
    """Sites with their substitution codes, most frequent base last, so that the order of codes decides nothing but ties."""
    codes = F.array_join(F.array_compact(F.array(*[F.when((F.col("reference") != b) & (F.col(f"count_{b}") > 0), F.concat("reference", F.lit(b))) for b in "ACGT"])), " ")
    return sites(spark, d).withColumn("all_subs", F.when(codes == "", "-").otherwise(codes))


@query(f"WITH {EDIT}, {SITE}, {ALT} SELECT region, position, sample_id, reference, coverage, alt, alt_count, round_even(alt_count / coverage::DOUBLE, 6) AS alt_share FROM alt")
def editing_primary_alt(spark, d):
    x = E.primary_alt(_coded(spark, d))
    return x.select("region", "position", "sample_id", "reference", "coverage", "alt", "alt_count", r6(F.col("alt_share")).alias("alt_share"))


@query(f"""WITH {EDIT}, {SITE}, {ALT}, rna AS (SELECT *, coverage >= 3 AND alt IS NOT NULL AS ok FROM alt WHERE sample_id = 's0'), dna AS (SELECT * FROM site WHERE sample_id = 's1'),
j AS (SELECT rna.region, rna.position, rna.alt, ok, CASE WHEN ok THEN dna.coverage END AS dna_coverage, CASE WHEN ok THEN CASE rna.alt WHEN 'A' THEN dna.count_A WHEN 'C' THEN dna.count_C WHEN 'G' THEN dna.count_G WHEN 'T' THEN dna.count_T END END AS dna_alt_reads FROM rna LEFT JOIN dna ON rna.region = dna.region AND rna.position = dna.position)
SELECT region, position, alt, dna_coverage, dna_alt_reads, round_even(dna_alt_reads / nullif(dna_coverage, 0)::DOUBLE, 6) AS dna_alt_freq, CASE WHEN NOT ok THEN NULL WHEN coalesce(dna_coverage, 0) < 5 THEN 'undetermined' WHEN dna_alt_reads >= 1 AND dna_alt_reads / dna_coverage::DOUBLE >= 0.1 THEN 'germline' ELSE 'confirmed_somatic' END AS germline_status FROM j""")
def germline_flag(spark, d):
    s = _coded(spark, d)
    x = E.germline(E.primary_alt(s.where("sample_id = 's0'")), s.where("sample_id = 's1'"), F.col("coverage") >= 3, 5, 1, 0.1)
    return x.select("region", "position", "alt", "dna_coverage", "dna_alt_reads", r6(F.col("dna_alt_freq")).alias("dna_alt_freq"), "germline_status")


@query(f"""WITH {EDIT}, {SITE}, cat AS (SELECT DISTINCT 'c' || (p_partkey % 8) AS region, p_partkey % 500 AS position, CASE WHEN p_partkey // 4 % 2 = 0 THEN '+' ELSE '-' END AS gtf_strand, CASE WHEN p_partkey % 3 = 0 THEN 'target' ELSE 'control' END AS grp FROM part),
j AS (SELECT sample_id, grp, coverage, CASE WHEN gtf_strand = '-' THEN count_A ELSE count_T END AS n FROM site JOIN cat USING (region, position) WHERE reference = CASE WHEN gtf_strand = '-' THEN 'G' ELSE 'C' END) SELECT sample_id, grp, count(*) AS n_sites, count(*) FILTER (n > 0) AS n_edited, round_even(avg(n / coverage::DOUBLE), 6) AS mean_rate, round_even(sum(n) / sum(coverage)::DOUBLE, 6) AS pooled_rate FROM j GROUP BY 1, 2""")
def motif_rates(spark, d):
    k = F.col("p_partkey")
    cat = table(spark, d, "part").select(F.concat(F.lit("c"), k % 8).alias("region"), (k % 500).alias("position"), F.when(F.floor(k / 4) % 2 == 0, "+").otherwise("-").alias("gtf_strand"), F.when(k % 3 == 0, "target").otherwise("control").alias("grp")).distinct()
    x = E.motif_rates(cat, sites(spark, d))
    return x.withColumns({"mean_rate": r6(F.col("mean_rate")), "pooled_rate": r6(F.col("pooled_rate"))})


@query(f"WITH {EDIT}, c AS (SELECT region, position, reference, sample_id, base FROM ed WHERE base <> reference GROUP BY ALL), g AS (SELECT sample_id, reference || base AS code, count(*) AS n FROM c GROUP BY 1, 2) SELECT *, round_even(n / sum(n) OVER (PARTITION BY sample_id), 6) AS share FROM g")
def substitution_spectrum(spark, d):
    x = edits(spark, d)
    per = None
    for s in ("s0", "s1", "s2"):
        y = E.base_counts(x.where(F.col("sample_id") == s)).withColumn("sample_id", F.lit(s))
        per = y if per is None else per.unionByName(y)
    return E.substitution_spectrum(per).withColumn("share", r6(F.col("share")))


PAIRS = [a + b for a in "ACGT" for b in "ACGT" if a != b]


@query(f"WITH {SEQS} SELECT id, length(seq)::BIGINT AS length, " + ", ".join(f"(length(seq) - length(replace(seq, '{b}', '')))::BIGINT AS \"n_{b}\"" for b in "ACGTN") + ", greatest(" + ", ".join(f"coalesce(list_max(list_transform(regexp_extract_all(seq, '{b}+'), lambda x: length(x))), 0)" for b in "ACGT") + ")::BIGINT AS longest_homopolymer, greatest(" + ", ".join(f"coalesce(list_max(list_transform(regexp_extract_all(seq, '(?:{p}){{2,}}'), lambda x: length(x))), 0)" for p in PAIRS) + ")::BIGINT AS longest_dinucleotide, round_even((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / nullif(length(replace(seq, 'N', '')), 0)::DOUBLE, 6) AS gc FROM sq")
def seq_composition(spark, d):
    return SQ.composition(sequences(spark, d)).withColumn("gc", r6(F.col("gc")))


@query(f"WITH {SEQS}, k AS (SELECT substr(seq, i::INT, 4) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM sq)) SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def seq_kmers(spark, d):
    return SQ.kmers(sequences(spark, d), 4)


@query(f"WITH {SEQS}, k AS (SELECT id, i - 1 AS position FROM (SELECT id, seq, unnest(range(1, length(seq) - 4)) AS i FROM sq) WHERE substr(seq, i::INT, 6) = 'ACGTAC') SELECT id, position::INT AS position FROM k")
def seq_motif_positions(spark, d):
    return SQ.motif_positions(sequences(spark, d), "ACGTAC")


# --- models: no SQL, rows only -----------------------------------------------------------------------------------


@query()
def ols_fits(spark, d):
    v = counts(spark, d).join(samples(spark), "sample_id")
    v = v.select("feature_id", F.log2(F.col("value") + 1).alias("value"), (F.col("grp") == "b").cast("double").alias("grp_b"), F.col("batch").cast("double").alias("batch"))
    return M.ols_per_feature(v, ["grp_b", "batch"])


@query()
def nb_fits(spark, d):
    c = counts(spark, d)
    v = c.join(V.size_factors(c), "sample_id").join(samples(spark), "sample_id").select("feature_id", "value", "size_factor", "grp")
    return T.bh(M.negative_binomial(v))


@query()
def enrichment_test(spark, d):
    x = ora_counts(spark, d)
    return T.bh(T.tails(x, "hyper", ["overlap", "n_universe", "set_size", "n_hits"]))


# --- identifiers, networks, labels, summaries -----------------------------------------------------------------------


@query(f"WITH {REG} SELECT region_id, CASE chr WHEN 'c0' THEN 'chr1' WHEN 'c3' THEN 'chrM' ELSE chr END AS chr, start, stop, strand FROM reg")
def rename_chromosomes(spark, d):
    return A.rename_chromosomes(regions(spark, d), {"c0": "chr1", "c3": "chrM"})


@query("WITH m AS (SELECT 'G' || (p_partkey % 700) AS id, min(p_brand) AS name FROM part WHERE p_partkey % 700 < 400 GROUP BY 1), g AS (SELECT DISTINCT 'G' || (l_partkey % 700) || '.' || (l_partkey % 3) AS gene FROM lineitem), x AS (SELECT gene, coalesce(name, split_part(gene, '.', 1)) AS name FROM g LEFT JOIN m ON split_part(gene, '.', 1) = id), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY gene) - 1 AS n FROM x) SELECT gene, CASE WHEN n > 0 THEN name || '.' || n ELSE name END AS name FROM r")
def convert_ids(spark, d):
    k = F.col("p_partkey") % 700
    m = table(spark, d, "part").where(k < 400).select(F.concat(F.lit("G"), k, F.lit(".7")).alias("id"), F.col("p_brand").alias("name"))
    g = table(spark, d, "lineitem").select(F.concat(F.lit("G"), F.col("l_partkey") % 700, F.lit("."), F.col("l_partkey") % 3).alias("gene")).distinct()
    return A.convert_ids(g, m).select("gene", "name")


@query(f"""WITH {DE}, x AS (SELECT feature_id AS gene, -sign("log2FoldChange") * log10(greatest(pvalue, 1e-300)) AS stat FROM de) SELECT gene, round_even(stat, 6) + 0.0 AS stat FROM x QUALIFY row_number() OVER (PARTITION BY gene ORDER BY abs(stat) DESC, stat DESC) = 1""")
def rank_from_results(spark, d):
    return A.rank_from_results(results(spark, d)).withColumn("stat", r6(F.col("stat")) + 0.0)


@query("SELECT p_brand AS module, p_type AS source, p_name || p_partkey AS term, (p_size % 37) / 37.0 AS pvalue, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY (p_size % 37) / 37.0, p_name || p_partkey)::INT AS rank FROM part WHERE (p_size % 37) / 37.0 <= 0.5 AND p_type IN ('SMALL', 'LARGE') QUALIFY rank <= 3")
def enrichment_top_terms(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("source"), F.concat("p_name", "p_partkey").alias("term"), (F.col("p_size") % 37 / F.lit(37.0)).alias("pvalue"))
    return A.filter_enrichment(t, 3, 0.5, ["SMALL", "LARGE"])


@query("WITH e AS (SELECT 'n' || (l_suppkey % 40) AS source, 'n' || (l_partkey % 45) AS target, l_linenumber AS n_resources FROM lineitem), g AS (SELECT DISTINCT 'n' || c_nationkey AS gene FROM customer) SELECT least(source, target) AS a, greatest(source, target) AS b, max(n_resources) AS n_resources FROM e WHERE source IN (SELECT gene FROM g) AND target IN (SELECT gene FROM g) AND source <> target AND n_resources >= 2 GROUP BY 1, 2")
def interaction_network(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("n"), F.col("l_suppkey") % 40).alias("source"), F.concat(F.lit("n"), F.col("l_partkey") % 45).alias("target"), F.col("l_linenumber").alias("n_resources"))
    g = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("gene")).distinct()
    return A.interactions(e, g, 2)


@query(f"WITH {EXPR} SELECT cell, cluster, CASE cluster WHEN 'k0' THEN 'B' WHEN 'k2' THEN 'T' END AS assigned FROM cel")
def assign_labels(spark, d):
    labels = spark.createDataFrame([("k0", "B"), ("k2", "T"), ("k2", "Z"), ("k9", "none")], "cluster string, label string")
    return A.assign_labels(cell_table(spark, d).select("cell", "cluster"), labels)


@query(f"WITH {REG} SELECT region_id::VARCHAR AS \"GeneID\", chr AS \"Chr\", start + 1 AS \"Start\", stop AS \"End\", '.' AS \"Strand\" FROM reg")
def peaks_to_saf(spark, d):
    return A.to_saf(regions(spark, d).withColumn("peak_id", F.col("region_id").cast("string")))


@query(f"WITH {REG} SELECT region_id AS name, chr, greatest(0, start + (region_id % 60 - 5) - 100) AS start, start + (region_id % 60 - 5) + 100 AS stop FROM reg WHERE region_id % 60 - 5 >= 0")
def summit_windows(spark, d):
    r = regions(spark, d).select(F.col("region_id").alias("name"), "chr", "start", (F.col("region_id") % 60 - 5).alias("peak_summit"))
    return A.summit_windows(r, 100)


@query("SELECT p_brand AS set_id, p_name || p_partkey AS motif, (p_partkey % 91) / 91.0 AS pvalue, (p_partkey % 83) / 83.0 AS qvalue, p_size AS pct_target, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey % 83) / 83.0, p_name || p_partkey)::INT AS rank FROM part WHERE (p_partkey % 83) / 83.0 <= 0.3 AND p_size >= 10 QUALIFY rank <= 5")
def filter_motifs(spark, d):
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(F.col("p_brand").alias("set_id"), F.concat("p_name", k).alias("motif"), (k % 91 / F.lit(91.0)).alias("pvalue"), (k % 83 / F.lit(83.0)).alias("qvalue"), F.col("p_size").alias("pct_target"))
    return A.filter_motifs(m, 0.3, None, 10, 5)


@query(f"WITH {CNT} SELECT sample_id, sum(value)::BIGINT AS total, round_even(avg(value), 6) AS mean, count(*) FILTER (value > 0) AS n_detected FROM cnt GROUP BY 1")
def quantification_summary(spark, d):
    return A.quantification_summary(counts(spark, d)).withColumn("mean", r6(F.col("mean")))


@query(f"WITH {FRAG}, {REG}, v AS (SELECT region_id, sample_id, count(*) AS value FROM frag f JOIN reg r ON f.chr = r.chr AND f.start < r.stop AND r.start < f.stop GROUP BY 1, 2) SELECT region_id AS feature_id, sample_id, coalesce(value, 0) AS value FROM reg CROSS JOIN (SELECT DISTINCT sample_id FROM frag) LEFT JOIN v USING (region_id, sample_id)")
def quantify_dense(spark, d):
    f, r = fragments(spark, d), regions(spark, d)
    v = I.count_overlaps(r, f, "region_id", ["sample_id"]).withColumnRenamed("region_id", "feature_id")
    return A.densify(v, r.select(F.col("region_id").alias("feature_id")), f)


@query("WITH s AS (SELECT c_mktsegment AS omics, 'g' || (c_custkey % 3) AS \"group\", c_custkey % 2 AS batch, c_nationkey AS bio_rep FROM customer) SELECT omics, \"group\", batch, count(*) AS n, count(DISTINCT bio_rep) AS n_bio_reps FROM s GROUP BY GROUPING SETS ((omics), (\"group\"), (batch), (omics, \"group\"))")
def sheet_summary(spark, d):
    c = table(spark, d, "customer")
    return A.sheet_summary(c.select(F.col("c_mktsegment").alias("omics"), F.concat(F.lit("g"), F.col("c_custkey") % 3).alias("group"), (F.col("c_custkey") % 2).alias("batch"), F.col("c_nationkey").alias("bio_rep")))


ISO = f"WITH {SAM}, v AS (SELECT p_brand AS gene_id, p_type AS transcript_id, 's' || (l_suppkey % 12) AS sample_id, sum(l_quantity::BIGINT)::BIGINT AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), sh AS (SELECT *, value / sum(value) OVER (PARTITION BY gene_id, sample_id) AS share FROM v)"


def _isoforms(spark, d):
    p = F.split("feature_id", "\\|")
    return counts(spark, d).select(p[0].alias("gene_id"), p[1].alias("transcript_id"), "sample_id", "value")


@query(f"{ISO} SELECT gene_id, transcript_id, round_even(avg(share) FILTER (grp = 'a'), 6) AS share_a, round_even(avg(share) FILTER (grp = 'b'), 6) AS share_b, round_even(avg(share) FILTER (grp = 'b') - avg(share) FILTER (grp = 'a'), 6) + 0.0 AS difference FROM sh JOIN sam USING (sample_id) GROUP BY 1, 2")
def isoform_switch(spark, d):
    x = A.isoform_switch(_isoforms(spark, d), samples(spark), "a", "b")
    return x.select("gene_id", "transcript_id", r6(F.col("share_a")).alias("share_a"), r6(F.col("share_b")).alias("share_b"), (r6(F.col("difference")) + 0.0).alias("difference"))


@query("SELECT s_name AS feature_id, 'x' AS term, round_even(s_acctbal / 5000, 6) AS estimate, round_even(s_acctbal / 5000 - 1.959963984540054 * 0.2, 6) AS low, round_even(s_acctbal / 5000 + 1.959963984540054 * 0.2, 6) AS high, round_even(exp(s_acctbal / 5000), 6) AS odds_ratio, round_even(exp(s_acctbal / 5000 - 1.959963984540054 * 0.2), 6) AS or_low, round_even(exp(s_acctbal / 5000 + 1.959963984540054 * 0.2), 6) AS or_high, CASE WHEN s_suppkey / 1000.0 < 0.001 THEN '***' WHEN s_suppkey / 1000.0 < 0.01 THEN '**' WHEN s_suppkey / 1000.0 < 0.05 THEN '*' ELSE '' END AS stars FROM supplier")
def coefficient_table(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("feature_id"), F.lit("x").alias("term"), (F.col("s_acctbal") / 5000).alias("estimate"), F.lit(0.2).alias("std_error"), (F.col("s_suppkey") / 1000.0).alias("pvalue"))
    x = A.coefficient_table(s)
    return x.select("feature_id", "term", "stars", *[r6(F.col(c)).alias(c) for c in ("estimate", "low", "high", "odds_ratio", "or_low", "or_high")])


MOD = f"WITH {CNT}, g AS (SELECT feature_id AS variable, sample_id AS item, value FROM cnt), t AS (SELECT 'trait' || j AS variable, 's' || k AS item, ((k * 7 + j * 5) % 11)::DOUBLE AS value FROM range(12) a(k), range(3) b(j)), p AS (SELECT g.variable AS x, t.variable AS y, g.value AS u, t.value AS v FROM g JOIN t USING (item)), mt AS (SELECT x, y, count(*) AS n, corr(u, v) AS r FROM p GROUP BY 1, 2)"


def _traits(spark):
    k = spark.range(12).crossJoin(spark.range(3).withColumnRenamed("id", "j"))
    return k.select(F.concat(F.lit("trait"), "j").alias("variable"), F.concat(F.lit("s"), "id").alias("item"), ((F.col("id") * 7 + F.col("j") * 5) % 11).cast("double").alias("value"))


def _module_traits(spark, d):
    return A.correlate_tables(counts(spark, d).select(F.col("feature_id").alias("variable"), F.col("sample_id").alias("item"), "value"), _traits(spark))


@query(f"{MOD} SELECT x, y, n, round_even(r, 6) AS r, round_even(r * sqrt((n - 2) / (1 - r * r)), 6) AS t, n - 2 AS df FROM mt")
def module_traits(spark, d):
    return _module_traits(spark, d).withColumns({"r": r6(F.col("r")), "t": r6(F.col("t"))})


@query(f"{MOD}, h AS (SELECT split_part(a.x, '|', 2) AS module, a.x AS gene, round(a.r, 9) AS r, round(b.r, 9) AS gs FROM mt a JOIN mt b ON a.x = b.x WHERE a.y = 'trait0' AND b.y = 'trait1' AND abs(a.r) >= 0.1 AND abs(b.r) >= 0.1) SELECT module, gene, round_even(r, 6) AS r, round_even(gs, 6) AS gs, row_number() OVER (PARTITION BY module ORDER BY abs(gs) DESC, gene)::INT AS rank FROM h QUALIFY rank <= 5")
def hub_genes(spark, d):
    mt = _module_traits(spark, d).withColumn("r", F.round("r", 9))
    member = mt.where("y = 'trait0'").select(F.split("x", "\\|")[1].alias("module"), F.col("x").alias("gene"), "r")
    x = A.hub_genes(member, mt.where("y = 'trait1'").select(F.col("x").alias("gene"), "r"), 0.1, 0.1, 5)
    return x.select("module", "gene", r6(F.col("r")).alias("r"), r6(F.col("gs")).alias("gs"), "rank")


@query("WITH a AS (SELECT p_brand AS variable, sum(p_size)::DOUBLE AS v FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1), b AS (SELECT p_brand AS variable, count(*)::DOUBLE AS v FROM part WHERE p_brand <> 'Brand#7' GROUP BY 1), x AS (SELECT variable, coalesce(a.v, 0) AS va, coalesce(b.v, 0) AS vb FROM a FULL JOIN b USING (variable)), r AS (SELECT *, (rank() OVER (ORDER BY va) + (count(*) OVER (PARTITION BY va) - 1) / 2.0) / count(*) OVER () AS rank_a, (rank() OVER (ORDER BY vb) + (count(*) OVER (PARTITION BY vb) - 1) / 2.0) / count(*) OVER () AS rank_b FROM x) SELECT variable, va, vb, round_even(rank_a, 6) AS rank_a, round_even(rank_b, 6) AS rank_b, round_even((rank_a + rank_b) / 2, 6) AS mean_rank, rank_a <= 0.25 AND rank_b <= 0.25 AS low FROM r")
def compare_importance(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_brand <> 'Brand#3'").groupBy(F.col("p_brand").alias("variable")).agg(F.sum("p_size").cast("double").alias("value"))
    b = p.where("p_brand <> 'Brand#7'").groupBy(F.col("p_brand").alias("variable")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return A.compare_importance(a, b).withColumns({c: r6(F.col(c)) for c in ("rank_a", "rank_b", "mean_rank")})


@query(f"{KNN}, t AS (SELECT vec_id AS other, label AS cluster, (vec_id % 10) / 10.0 AS margin FROM embeddings), j AS (SELECT id, cluster, count(*) AS n, sum(margin) AS s, min(margin) AS m FROM knn JOIN t USING (other) GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER w AS a, sum(s) OVER w AS ts, min(m) OVER w AS lm, row_number() OVER (PARTITION BY id ORDER BY n DESC, cluster) AS k FROM j WINDOW w AS (PARTITION BY id)) SELECT id, cluster, round_even(n / a, 6) AS purity, round_even(ts / a, 6) AS mean_margin, lm::DOUBLE AS least_margin FROM r WHERE k = 1")
def projection_confidence(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), (F.col("vec_id") % 10 / F.lit(10.0)).alias("margin"))
    x = A.projection_confidence(_knn(spark, d), t)
    return x.withColumns({"purity": r6(F.col("purity")), "mean_margin": r6(F.col("mean_margin"))})


@query(f"{NET}, a AS (SELECT source, sample_id, sum(value * mor) AS score FROM cnt JOIN net ON feature_id = target GROUP BY 1, 2) SELECT source, round_even(avg(abs(score)), 6) AS strength FROM a GROUP BY 1 ORDER BY avg(abs(score)) DESC, source LIMIT 3")
def top_activities(spark, d):
    c = counts(spark, d)
    return A.top_activities(X.activity(c, _net(c), "wsum", 1), "mean_abs", 3).withColumn("strength", r6(F.col("strength")))


@query(f"{NET}, a AS (SELECT 'wsum' AS method, source, sample_id, sum(value * mor) AS score FROM cnt JOIN net ON feature_id = target GROUP BY 2, 3 UNION ALL SELECT 'wmean', source, sample_id, sum(value * mor) / nullif(sum(abs(mor)), 0) FROM cnt JOIN net ON feature_id = target GROUP BY 2, 3), z AS (SELECT *, (score - avg(score) OVER w) / stddev_samp(score) OVER w AS z FROM a WINDOW w AS (PARTITION BY method)) SELECT source, sample_id, round_even(avg(z), 5) AS consensus, count(*) AS n_methods FROM z GROUP BY 1, 2")
def consensus_activity(spark, d):
    c = counts(spark, d)
    n = _net(c)
    m = [X.activity(c, n, k, 1).select(F.lit(k).alias("method"), "source", "sample_id", "score") for k in ("wsum", "wmean")]
    return A.consensus_scores(m[0].unionAll(m[1])).withColumn("consensus", F.bround("consensus", 5))


# --- batches, time, markers, distances, signal ------------------------------------------------------------------------


@query(f"WITH {CNT}, {SAM} SELECT feature_id, sample_id, round_even(value - avg(value) OVER (PARTITION BY feature_id, grp, batch) + avg(value) OVER (PARTITION BY feature_id, grp), 6) AS value FROM cnt JOIN sam USING (sample_id)")
def correct_batch(spark, d):
    return MV.correct_batch(counts(spark, d), samples(spark)).withColumn("value", r6(F.col("value")))


TIME = "WITH v AS (SELECT event_type AS feature_id, hour(ts) // 6 AS timepoint, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS grp, value FROM events)"


def _times(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("feature_id"), F.floor(F.hour("ts") / 6).alias("timepoint"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("grp"), "value")


@query(f"{TIME}, g AS (SELECT feature_id, timepoint, avg(value) FILTER (grp = 'a') AS ma, avg(value) FILTER (grp = 'b') AS mb, var_samp(value) FILTER (grp = 'a') / count(*) FILTER (grp = 'a') AS sa, var_samp(value) FILTER (grp = 'b') / count(*) FILTER (grp = 'b') AS sb, count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb FROM v GROUP BY 1, 2) SELECT feature_id, timepoint, na, nb, round_even(ma - mb, 6) AS diff, round_even((ma - mb) / sqrt(sa + sb), 6) AS t, round_even((sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)), 5) AS df FROM g WHERE na > 1 AND nb > 1")
def timeseries_conditional(spark, d):
    x = MV.by_timepoint(_times(spark, d))
    return x.select("feature_id", "timepoint", "na", "nb", r6(F.col("diff")).alias("diff"), r6(F.col("t")).alias("t"), F.bround("df", 5).alias("df"))


@query(f"{TIME}, m AS (SELECT feature_id, grp, timepoint, avg(value) AS mean FROM v GROUP BY ALL), x AS (SELECT *, lead(timepoint) OVER w AS next, lead(mean) OVER w AS next_mean FROM m WINDOW w AS (PARTITION BY feature_id, grp ORDER BY timepoint)) SELECT feature_id, grp, timepoint, next, round_even(next_mean - mean, 6) AS difference FROM x WHERE next IS NOT NULL")
def timeseries_temporal(spark, d):
    return MV.between_timepoints(_times(spark, d)).select("feature_id", "grp", "timepoint", "next", r6(F.col("difference")).alias("difference"))


@query(f"{TIME}, m AS (SELECT feature_id, grp, timepoint, avg(value) AS mean FROM v GROUP BY ALL) SELECT a.feature_id, a.grp, a.timepoint, b.timepoint AS next, round_even(b.mean - a.mean, 6) AS difference FROM m a JOIN m b ON a.feature_id = b.feature_id AND a.grp = b.grp AND a.timepoint < b.timepoint")
def timeseries_all_pairs(spark, d):
    return MV.between_timepoints(_times(spark, d), False).select("feature_id", "grp", "timepoint", "next", r6(F.col("difference")).alias("difference"))


PW = """WITH c AS (SELECT user_id AS cell, 'k' || (user_id % 3) AS cluster FROM events GROUP BY 1), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1), e AS (SELECT user_id AS cell, event_type AS gene, count(*) AS v FROM events GROUP BY 1, 2),
x AS (SELECT c.cell, cluster, g.gene, coalesce(v, 0)::DOUBLE AS value FROM c CROSS JOIN (SELECT DISTINCT event_type AS gene FROM events) g LEFT JOIN e ON e.cell = c.cell AND e.gene = g.gene)"""


def _grid_cells(spark, d):
    e = table(spark, d, "events")
    u = F.col("cell")
    c = e.select(F.col("user_id").alias("cell")).distinct().withColumn("cluster", F.concat(F.lit("k"), u % 3))
    n = e.groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("gene")).agg(F.count(F.lit(1)).alias("v"))
    g = c.select("cell").crossJoin(F.broadcast(e.select(F.col("event_type").alias("gene")).distinct()))
    return g.join(n, ["cell", "gene"], "left").select("cell", "gene", F.coalesce("v", F.lit(0)).cast("double").alias("value")), c


@query(f"{PW}, a AS (SELECT p.gene, p.cluster AS cluster_a, q.cluster AS cluster_b, sum(CASE WHEN p.value > q.value THEN 1 WHEN p.value = q.value THEN 0.5 ELSE 0 END)::DOUBLE AS won FROM x p JOIN x q ON p.gene = q.gene AND p.cluster <> q.cluster GROUP BY ALL), m AS (SELECT gene, cluster, avg(value) AS m, var_samp(value) AS v, avg((value > 0)::INT) AS d FROM x GROUP BY ALL) SELECT gene, cluster_a, cluster_b, round_even(won / (na.n * nb.n), 6) AS auc, round_even((ma.m - mb.m) / sqrt((ma.v + mb.v) / 2), 6) AS cohens_d, round_even(log2((ma.d + 0.01) / (mb.d + 0.01)), 6) + 0.0 AS detected_lfc FROM a JOIN m ma ON ma.gene = a.gene AND ma.cluster = cluster_a JOIN m mb ON mb.gene = a.gene AND mb.cluster = cluster_b JOIN n na ON na.cluster = cluster_a JOIN n nb ON nb.cluster = cluster_b".replace("SELECT gene, cluster_a", "SELECT a.gene AS gene, cluster_a"))
def pairwise_markers(spark, d):
    x = MV.pairwise_markers(*_grid_cells(spark, d))
    return x.select("gene", "cluster_a", "cluster_b", r6(F.col("auc")).alias("auc"), r6(F.col("cohens_d")).alias("cohens_d"), (r6(F.col("detected_lfc")) + 0.0).alias("detected_lfc"))


@query(f"{PW}, ref AS (SELECT 'L' || (row_number() OVER (ORDER BY gene) % 1 + j) AS label, gene, ((ascii(gene) * (j + 2) + length(gene) * j) % 17)::DOUBLE AS value FROM (SELECT DISTINCT gene FROM x), range(3) t(j)), p AS (SELECT cell, label, x.value AS u, ref.value AS v FROM x JOIN ref USING (gene)), q AS (SELECT cell, label, rank() OVER (PARTITION BY cell, label ORDER BY u) + (count(*) OVER (PARTITION BY cell, label, u) - 1) / 2.0 AS ru, rank() OVER (PARTITION BY cell, label ORDER BY v) + (count(*) OVER (PARTITION BY cell, label, v) - 1) / 2.0 AS rv FROM p), g AS (SELECT cell, label, round(corr(ru, rv), 9) AS r FROM q GROUP BY 1, 2) SELECT cell, label, round_even(r, 6) + 0.0 AS r FROM g WHERE r IS NOT NULL AND NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY g.r DESC, label) = 1")
def reference_labels(spark, d):
    x, _ = _grid_cells(spark, d)
    ref = x.select("gene").distinct().crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "j")))
    ref = ref.select(F.concat(F.lit("L"), "j").alias("label"), "gene", ((F.ascii("gene") * (F.col("j") + 2) + F.length("gene") * F.col("j")) % 17).cast("double").alias("value"))
    return MV.reference_labels(x, ref).withColumn("r", r6(F.col("r")) + 0.0)


@query("WITH i AS (SELECT * FROM supplier), r AS (SELECT (max(s_acctbal) - min(s_acctbal)) AS r FROM i) SELECT a.s_suppkey AS x, b.s_suppkey AS y, round_even((abs(a.s_acctbal - b.s_acctbal) / r + (a.s_nationkey <> b.s_nationkey)::INT) / 2.0, 6) AS distance FROM i a JOIN i b ON a.s_suppkey < b.s_suppkey, r")
def gower_distance(spark, d):
    return MV.gower(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal"], ["s_nationkey"]).withColumn("distance", r6(F.col("distance")))


@query("WITH x AS (SELECT label AS cluster, vec_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT cluster, dim, count(*) AS n, var_pop(v) * count(*) AS ss FROM x GROUP BY 1, 2) SELECT cluster, max(n) AS n, round_even(sum(ss), 5) AS within_ss FROM g GROUP BY 1")
def cluster_within_ss(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return MV.within_ss(p, e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))).withColumn("within_ss", F.bround("within_ss", 5))


@query(f"{COV}, {REG}, s AS (SELECT region_id, sum((least(cov.stop, reg.stop) - greatest(cov.start, reg.start)) * depth) AS s FROM cov JOIN reg ON cov.chr = reg.chr AND cov.start < reg.stop AND reg.start < cov.stop GROUP BY 1) SELECT region_id, chr, start, stop, round_even(coalesce(s, 0) / nullif(stop - start, 0)::DOUBLE, 6) AS signal FROM reg LEFT JOIN s USING (region_id)")
def signal_over_regions(spark, d):
    c = I.coverage(fragments(spark, d)).withColumn("score", F.col("depth").cast("double")).drop("depth")
    x = MV.signal_over_regions(c, regions(spark, d).drop("strand"), "region_id")
    return x.withColumn("signal", r6(F.col("signal")))


@query(f"WITH {FRAG}, e AS (SELECT sample_id, chr, start, stop, unnest(range(start // 2000, (stop - 1) // 2000 + 1)) AS k FROM frag WHERE sample_id IN ('s0', 's1')), b AS (SELECT sample_id, chr, k, sum(least(stop, (k + 1) * 2000) - greatest(start, k * 2000)) / 2000.0 AS score FROM e GROUP BY ALL), p AS (SELECT chr, k, coalesce(max(score) FILTER (sample_id = 's0'), 0) AS a, coalesce(max(score) FILTER (sample_id = 's1'), 0) AS b FROM b GROUP BY 1, 2) SELECT chr, k * 2000 AS start, (k + 1) * 2000 AS stop, round_even(log2((b + 0.1) / (a + 0.1)), 6) + 0.0 AS log2_ratio FROM p WHERE greatest(a, b) >= 0.01")
def tile_comparison(spark, d):
    f = fragments(spark, d)
    t = [I.bin_average(I.coverage(f.where(F.col("sample_id") == s)), 2000) for s in ("s0", "s1")]
    x = MV.tile_comparison(t[0], t[1], 0.1, 0.01)
    return x.select("chr", "start", "stop", (r6(F.col("log2_ratio")) + 0.0).alias("log2_ratio"))


@query(ORACLE_SQL["tss_profile"].replace("WITH ", "WITH prof AS (WITH ", 1) + ") SELECT bin, n, round_even(n / (SELECT avg(n) FROM prof, (SELECT min(bin) AS lo, max(bin) AS hi FROM prof) WHERE bin < lo + 2 OR bin > hi - 2), 6) AS enrichment FROM prof")
def tss_enrichment(spark, d):
    return MV.enrichment_over_flanks(tss_profile(spark, d), 2).withColumn("enrichment", r6(F.col("enrichment")))


@query("SELECT c_custkey, c_mktsegment, (c_mktsegment = 'BUILDING')::INT AS c_mktsegment_BUILDING, (c_mktsegment = 'MACHINERY')::INT AS c_mktsegment_MACHINERY FROM customer")
def dummy_coding(spark, d):
    return MV.dummy_code(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"])


@query(ORACLE_SQL["cell_composition"].replace("SELECT sample_id, cluster, coalesce(n, 0) AS n, round_even(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY sample_id), 6) AS share FROM g LEFT JOIN c USING (sample_id, cluster)", "SELECT sample_id, cluster, n, round_even(ln(p / (1 - p)), 6) AS logit FROM (SELECT sample_id, cluster, n, (n + 0.5) / (sum(n) OVER w + 0.5 * count(*) OVER w) AS p FROM (SELECT sample_id, cluster, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (sample_id, cluster)) WINDOW w AS (PARTITION BY sample_id))"))
def composition_logit(spark, d):
    return MV.logit_shares(C.composition(cell_table(spark, d)).drop("share")).withColumn("logit", r6(F.col("logit")))


@query(f"{COR}, r AS (SELECT x, y, corr(u, v) AS r FROM p GROUP BY 1, 2), b AS (SELECT x AS v, r FROM r UNION ALL SELECT y, r FROM r) SELECT v, round_even(sum(pow(abs(r), 6)), 6) AS connectivity FROM b GROUP BY 1")
def network_connectivity(spark, d):
    v = counts(spark, d).select(F.col("sample_id").alias("variable"), F.col("feature_id").alias("item"), "value")
    return MV.adjacency_power(T.correlation_pairs(v), 6.0).withColumn("connectivity", r6(F.col("connectivity")))


@query("""WITH x AS (SELECT s_suppkey, s_acctbal / 2000 - 2 AS v FROM supplier) SELECT s_suppkey, round_even(sign(v) * greatest(abs(v) - 0.5, 0), 6) + 0.0 AS soft, round_even(CASE WHEN abs(v) <= 1 THEN sign(v) * greatest(abs(v) - 0.5, 0) WHEN abs(v) <= 1.85 THEN (2.7 * v - sign(v) * 1.85) / 1.7 ELSE v END, 6) + 0.0 AS scad, round_even(CASE WHEN abs(v) > 0.5 THEN sign(v) * (abs(v) - 0.5) ELSE 0.25 END, 6) + 0.0 AS proximal, round_even(CASE WHEN v > 0.8 * 0.4 THEN (v - 0.8 * 0.4) / (1 + 2 * 0.8 * 0.3) WHEN v < -0.8 * 0.4 THEN (v + 0.8 * 0.4) / (1 + 2 * 0.8 * 0.3) ELSE 0.25 END, 6) + 0.0 AS elastic,
round_even(CASE WHEN 0 < v - 0.4 AND v - 0.4 <= 0.5 THEN v - 0.4 WHEN -0.5 <= v + 0.4 AND v + 0.4 < 0 THEN v + 0.4 WHEN 0.5 < (v - 0.8 * e2) / (1 + 1.6 * e1) AND (v - 0.8 * e2) / (1 + 1.6 * e1) <= 1.85 THEN (v - 0.8 * e2) / (1 + 1.6 * e1)
WHEN -1.85 <= (v + 0.8 * e2) / (1 + 1.6 * e1) AND (v + 0.8 * e2) / (1 + 1.6 * e1) <= -0.5 THEN (v + 0.8 * e2) / (1 + 1.6 * e1) WHEN abs(v) > 1.85 THEN v ELSE 0.25 END, 6) + 0.0 AS proximal_scad,
round_even(CASE WHEN w >= 0.05 AND w <= 0.3 THEN 1.0 WHEN w < 0.05 THEN exp(-2 * (0.05 - w) / 0.05) ELSE exp(-2 * (w - 0.3) / 0.7) END, 6) AS quality FROM (SELECT *, -1 / 5.4 AS e1, 3.7 / 5.4 AS e2, abs(v) / 4 AS w FROM x)""")
def penalty_functions(spark, d):
    x = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 2000 - 2).alias("v"))
    v = F.col("v")
    z = lambda c: r6(c) + 0.0
    return x.select("s_suppkey", z(P.soft(v, 0.5)).alias("soft"), z(P.scad(v, 0.5)).alias("scad"), z(P.proximal_lasso(v, F.lit(0.25), 0.5)).alias("proximal"), z(P.proximal_elastic(v, F.lit(0.25), 0.3, 0.4, 0.8)).alias("elastic"), z(P.proximal_scad(v, F.lit(0.25), 0.5, 0.8)).alias("proximal_scad"), r6(P.sparsity_quality(F.abs(v) / 4)).alias("quality"))


@query("WITH n AS (SELECT count(*) AS n FROM customer), f AS (SELECT f, (((f + 1) * n + 4) // 5) - ((f * n + 4) // 5) AS n FROM range(5) t(f), n) SELECT f::INT AS fold, n FROM f")
def folds_equal(spark, d):
    return P.folds(table(spark, d, "customer").select("c_custkey"), "c_custkey", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# --- plot frames -------------------------------------------------------------------------------------------------------


@query(f"""WITH {DE} SELECT feature_id, comparison, "log2FoldChange", pvalue, round_even(-log10(greatest(pvalue, 1e-300)), 6) AS neg_log10_p, CASE WHEN {SIG} AND "log2FoldChange" > 0 THEN 'up' WHEN {SIG} THEN 'down' ELSE 'none' END AS class FROM de""")
def plot_volcano(spark, d):
    return PD.volcano(results(spark, d), **CUTS).withColumn("neg_log10_p", r6(F.col("neg_log10_p")))


@query("SELECT floor(l_quantity / 5) * 5 AS bin, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def plot_histogram(spark, d):
    return PD.histogram(table(spark, d, "lineitem"), "l_quantity", 5.0, ["l_returnflag"]).withColumn("bin", F.col("bin").cast("double"))


@query("WITH q AS (SELECT c_mktsegment AS g, count(*) AS n, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1) SELECT g, n, q1, m AS median, q3, min(c_acctbal) FILTER (c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(c_acctbal) FILTER (c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (NOT c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers FROM customer JOIN q ON c_mktsegment = g GROUP BY 1, 2, 3, 4, 5")
def plot_box(spark, d):
    return PD.box(table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("value")), ["g"])


@query("WITH m AS (SELECT o_custkey AS item, string_agg(DISTINCT o_orderpriority, '&' ORDER BY o_orderpriority) AS combination FROM orders GROUP BY 1) SELECT combination, count(*) AS n FROM m GROUP BY 1")
def plot_upset(spark, d):
    return PD.upset(table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("set_id")))


@query(f"WITH {CNT} SELECT feature_id, sample_id, round_even(greatest(-3, least(3, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0))), 6) AS z FROM cnt WINDOW w AS (PARTITION BY feature_id)")
def plot_heatmap(spark, d):
    return PD.heatmap(counts(spark, d)).withColumn("z", r6(F.col("z")))


# --- clustering, consensus, communities ---------------------------------------------------------------------------------


@query(f"WITH {CNT}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value, feature_id) AS k FROM cnt) SELECT feature_id, sample_id, round_even(avg(value) OVER (PARTITION BY k), 6) AS value FROM r")
def quantile_normalize(spark, d):
    return K.quantile_normalize(counts(spark, d)).withColumn("value", r6(F.col("value")))


RUNS = "a AS (SELECT vec_id AS item, r AS run, (vec_id * (r + 3) // 7 + label) % 4 AS cluster FROM embeddings, range(5) t(r) WHERE (vec_id + r) % 3 > 0)"


def _runs(spark, d):
    e = table(spark, d, "embeddings").crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "run"))).where("(vec_id + run) % 3 > 0")
    return e.select(F.col("vec_id").alias("item"), "run", ((F.floor(F.col("vec_id") * (F.col("run") + 3) / 7) + F.col("label")) % 4).alias("cluster"))


@query(f"WITH {RUNS} SELECT p.item AS x, q.item AS y, count(*) AS runs, round_even(avg((p.cluster = q.cluster)::INT), 6) AS consensus FROM a p JOIN a q ON p.run = q.run AND p.item < q.item GROUP BY 1, 2")
def consensus_matrix(spark, d):
    return K.consensus_matrix(_runs(spark, d)).withColumn("consensus", r6(F.col("consensus")))


@query(f"WITH {RUNS}, c AS (SELECT item, cluster, count(*) AS n FROM a GROUP BY 1, 2) SELECT item, round_even(max(n) / sum(n), 6) AS stability FROM c GROUP BY 1")
def consensus_stability(spark, d):
    return K.stability(_runs(spark, d)).withColumn("stability", r6(F.col("stability")))


@query(f"""{COR}, e AS (SELECT x, y, abs(corr(u, v)) AS a FROM p GROUP BY 1, 2), b AS (SELECT x, y, a FROM e UNION ALL SELECT y, x, a FROM e), g AS (SELECT x, sum(a) AS k FROM b GROUP BY 1), s AS (SELECT p.x AS x, q.y AS y, sum(p.a * q.a) AS l FROM b p JOIN b q ON p.y = q.x WHERE p.x < q.y GROUP BY 1, 2)
SELECT e.x AS x, e.y AS y, round_even((coalesce(l, 0) + a) / (least(gx.k, gy.k) + 1 - a), 6) AS overlap FROM e LEFT JOIN s ON s.x = e.x AND s.y = e.y JOIN g gx ON gx.x = e.x JOIN g gy ON gy.x = e.y""")
def topological_overlap(spark, d):
    v = counts(spark, d).select(F.col("sample_id").alias("variable"), F.col("feature_id").alias("item"), "value")
    a = T.correlation_pairs(v).select("x", "y", F.abs("r").alias("a"))
    return K.topological_overlap(a).withColumn("overlap", r6(F.col("overlap")))


@query("""WITH p AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.id AS id, a.cluster AS cluster, b.cluster AS other, sum(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS s, count(*) AS n FROM p a JOIN p b ON true GROUP BY 1, 2, 3),
m AS (SELECT id, cluster, max(CASE WHEN cluster = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN cluster <> other THEN s / n END) AS b FROM d GROUP BY 1, 2) SELECT id, cluster, round_even(coalesce((b - a) / greatest(a, b), 0), 6) + 0.0 AS silhouette FROM m""")
def cluster_silhouette(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    x = K.silhouette(p, e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")))
    return x.withColumn("silhouette", r6(F.col("silhouette")) + 0.0)


@query()
def kmeans_clusters(spark, d):
    return K.kmeans(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 5)


@query()
def communities(spark, d):
    from .more import new_folder

    return K.louvain(G.snn(_knn(spark, d)).select("a", "b", "weight"), new_folder(spark, "louvain"), rounds=8)


@query()
def deconvolution(spark, d):
    c = counts(spark, d)
    sig = c.groupBy(F.split("feature_id", "\\|")[1].alias("cell_type"), "feature_id").agg(F.avg("value").alias("weight"))
    return K.deconvolve(c, sig)


@query()
def gsea_permuted(spark, d):
    de = results(spark, d)
    ranked = de.where("comparison = 'y0'").select(F.col("feature_id").alias("gene"), F.col("log2FoldChange").alias("stat"))
    return K.gsea_permutation(ranked, de.select(F.split("feature_id", "\\|")[1].alias("set_id"), F.col("feature_id").alias("gene")), 50)


from . import more, rest  # noqa: E402,F401  register their queries too
