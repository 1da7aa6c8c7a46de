"""Further queries: upstream tables, pileups, modules, markers, exports and frames behind plots, each with its SQL."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import expression as X
from ..operators import inputs as N
from ..operators import intervals as I
from ..operators import modules as D
from ..operators import pileup as U
from ..operators import plotdata as PD
from ..operators import stats as T
from ..sources import readers as R
from ..sources import writers as W
from .catalog import (
    CNT, COR, COV, DE, EXPR, FRAG, LOGX, NET, ORACLE_SQL, SAM, _grid_cells, _net, cell_table, correlation_values, counts, expression, fragments, pairwise_markers, query, r6, results, samples, table,
)

# --- upstream tables ---------------------------------------------------------------------------------------------


def _runs(spark, d):
    li = table(spark, d, "lineitem")
    x = li.select("l_linenumber", F.concat(F.lit("b"), F.col("l_suppkey") % 20).alias("bc_wells"), F.concat(F.lit('"g'), F.col("l_partkey") % 30, F.lit('"')).alias("gene_name"), (F.col("l_returnflag") == "A").alias("exonic"))
    return [x.where(F.col("l_linenumber") % 2 == k).drop("l_linenumber") for k in (1, 0)]


SPL = """spl AS (SELECT 'b' || (l_suppkey % 20) || '__s' || CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS cell, 'g' || (l_partkey % 30) AS gene, count(*) FILTER (l_returnflag = 'A') AS spliced, count(*) FILTER (l_returnflag <> 'A') AS unspliced FROM lineitem GROUP BY 1, 2)"""


@query(f"WITH {SPL} SELECT * FROM spl")
def splice_counts(spark, d):
    return N.splice_counts(_runs(spark, d))


@query(f"""WITH {SPL}, gm AS (SELECT 'g' || (p_partkey % 25) AS gene, min(p_brand) AS biotype FROM part GROUP BY 1), cm AS (SELECT DISTINCT 'b' || (s_suppkey % 12) || '__s1' AS cell, 's' || (s_suppkey % 12 % 3) AS sample FROM supplier)
SELECT cell, gene, spliced, unspliced, sample, biotype FROM spl JOIN gm USING (gene) JOIN cm USING (cell)""")
def velocity_filtered(spark, d):
    k = F.col("s_suppkey") % 12
    cells = table(spark, d, "supplier").select(F.concat(F.lit("b"), k, F.lit("__s1")).alias("bc_wells"), F.concat(F.lit("s"), k % 3).alias("sample")).distinct()
    genes = table(spark, d, "part").select(F.concat(F.lit('"g'), F.col("p_partkey") % 25, F.lit('"')).alias("gene_name"), F.col("p_brand").alias("biotype"))
    return N.keep_described(N.splice_counts(_runs(spark, d)), cells, genes).select("cell", "gene", "spliced", "unspliced", "sample", "biotype")


@query(f"""WITH {SPL}, a AS (SELECT sum(spliced)::DOUBLE AS s, sum(unspliced)::DOUBLE AS u, count(DISTINCT cell) AS c, count(DISTINCT gene) AS g FROM spl)
SELECT 'complete' AS check, 'hard' AS level, true AS ok, 0.0::DOUBLE AS value UNION ALL SELECT 'whole_counts', 'hard', true, 0 UNION ALL SELECT 'not_negative', 'hard', true, 0 UNION ALL SELECT 'has_spliced', 'hard', s > 0, s FROM a UNION ALL SELECT 'has_unspliced', 'hard', u > 0, u FROM a
UNION ALL SELECT 'unspliced_share', 'soft', u / (s + u) BETWEEN 0.05 AND 0.6, round_even(u / (s + u), 6) FROM a UNION ALL SELECT 'cells', 'soft', c >= 50, c FROM a UNION ALL SELECT 'genes', 'soft', g >= 100, g FROM a""".replace("AS check", 'AS "check"'))
def velocity_ready(spark, d):
    return N.velocity_ready(N.splice_counts(_runs(spark, d))).withColumn("value", r6(F.col("value")))


@query("SELECT abs((l_quantity - 25) * 50)::BIGINT AS size, count(*) AS n FROM lineitem WHERE l_quantity <> 25 AND abs((l_quantity - 25) * 50) <= 1000 GROUP BY 1")
def fragment_sizes(spark, d):
    return N.fragment_sizes(table(spark, d, "lineitem").select(((F.col("l_quantity") - 25) * 50).cast("bigint").alias("tlen")))


@query("SELECT CASE WHEN l_suppkey % 8 > 5 THEN 'spikein' ELSE 'host' END AS side, CASE WHEN l_suppkey % 8 > 5 THEN 'spikein_' ELSE '' END || 'c' || (l_suppkey % 8) AS chr, count(*) AS n FROM lineitem GROUP BY 1, 2")
def spike_in_split(spark, d):
    k = F.col("l_suppkey") % 8
    reads = table(spark, d, "lineitem").select(F.concat(F.when(k > 5, "spikein_").otherwise(""), F.lit("c"), k).alias("chr"))
    host, spike = N.split_spike_in(reads)
    x = host.withColumn("side", F.lit("host")).unionByName(spike.withColumn("side", F.lit("spikein")))
    return x.groupBy("side", "chr").agg(F.count(F.lit(1)).alias("n"))


TE = """tv AS (SELECT 'L' || (l_partkey % 50) || ':F' || (l_partkey % 50 % 5) || ':C' || (l_partkey % 50 % 2) AS feature_id, 's' || (l_suppkey % 6) AS sample_id, sum(l_quantity::BIGINT)::BIGINT AS value FROM lineitem GROUP BY 1, 2),
ti AS (SELECT DISTINCT 'L' || k || ':F' || (k % 5) || ':C' || (k % 2) AS feature_id FROM (SELECT p_size % 50 AS k FROM part) WHERE k < 35)"""


def _elements(spark, d):
    k = F.col("l_partkey") % 50
    v = table(spark, d, "lineitem").groupBy(F.concat(F.lit("L"), k, F.lit(":F"), k % 5, F.lit(":C"), k % 2).alias("feature_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 6).alias("sample_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))
    p = F.col("p_size") % 50
    gtf = table(spark, d, "part").where(p < 35).select(F.concat(F.lit("L"), p).alias("gene_id"), F.concat(F.lit("F"), p % 5).alias("family_id"), F.concat(F.lit("C"), p % 2).alias("class_id"))
    return N.element_counts(v, N.element_ids(gtf))


@query(f"WITH {TE} SELECT * FROM tv WHERE feature_id IN (SELECT feature_id FROM ti)")
def element_counts(spark, d):
    return _elements(spark, d)


@query(f"WITH {TE}, {CNT} SELECT feature_id, sample_id, value FROM cnt WHERE sample_id IN ('s0', 's1', 's2', 's3', 's4', 's5') UNION ALL SELECT * FROM tv WHERE feature_id IN (SELECT feature_id FROM ti)")
def merged_counts(spark, d):
    return N.merge_counts(counts(spark, d), _elements(spark, d))


@query(f"WITH {EXPR}, g AS (SELECT gene FROM expr WHERE cell % 2 = 0 INTERSECT SELECT gene FROM expr WHERE cell % 2 = 1) SELECT gene, cell, counts, CASE WHEN cell % 2 = 0 THEN 'even' ELSE 'odd' END AS sample_id FROM expr WHERE gene IN (SELECT gene FROM g)")
def merged_cells(spark, d):
    e = expression(spark, d)
    even, odd = e.where("cell % 2 = 0"), e.where("cell % 2 = 1")
    g = even.select("gene").intersect(odd.select("gene"))
    return N.merge_cells({"even": even.join(g, "gene", "left_semi"), "odd": odd.join(g, "gene", "left_semi")})


@query("WITH v AS (SELECT CASE WHEN l_linenumber <= 3 THEN 'a' ELSE 'b' END AS view, l_suppkey AS sample, l_linenumber AS feature, CASE WHEN l_linenumber = 7 AND l_quantity > 49 THEN NULL ELSE l_quantity END AS value FROM lineitem), g AS (SELECT view, count(DISTINCT sample) AS n_samples, count(DISTINCT feature) AS n_features, count(*) FILTER (value IS NULL) AS n_missing FROM v GROUP BY 1) SELECT *, n_samples = max(n_samples) OVER () AND n_features > 0 AND n_missing = 0 AS ok FROM g")
def views_validated(spark, d):
    li = table(spark, d, "lineitem")
    v = li.select(F.when(F.col("l_linenumber") <= 3, "a").otherwise("b").alias("view"), F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("feature"), F.when(~((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 49)), F.col("l_quantity")).alias("value"))
    return N.validate_views(v)


@query("SELECT k::VARCHAR AS plain, 'chr' || k AS prefixed FROM range(1, 23) t(k) UNION ALL SELECT 'X', 'chrX' UNION ALL SELECT 'Y', 'chrY' UNION ALL SELECT 'MT', 'chrM'")
def chromosome_names(spark, d):
    return spark.createDataFrame(sorted(N.chromosome_names().items()), "plain string, prefixed string")


GAP = "gp AS (SELECT feature_id, sample_id, CASE WHEN (length(feature_id) + value) % 3 = 0 OR sample_id = 's3' AND value % 4 < 3 THEN NULL WHEN feature_id LIKE 'Brand#1|%' THEN 5 ELSE value END::DOUBLE AS value FROM cnt)"


@query(f"WITH {CNT}, {GAP}, g AS (SELECT feature_id FROM gp GROUP BY 1 HAVING count(value) >= 0.5 * (SELECT count(DISTINCT sample_id) FROM gp) AND var_samp(value) > 0), s AS (SELECT sample_id FROM gp WHERE feature_id IN (SELECT feature_id FROM g) GROUP BY 1 HAVING count(value) >= 0.5 * (SELECT count(*) FROM g)) SELECT * FROM gp WHERE feature_id IN (SELECT feature_id FROM g) AND sample_id IN (SELECT sample_id FROM s)")
def good_samples_genes(spark, d):
    v = F.col("value")
    gone = ((F.length("feature_id") + v) % 3 == 0) | ((F.col("sample_id") == "s3") & (v % 4 < 3))
    x = counts(spark, d).withColumn("value", F.when(~gone, F.when(F.col("feature_id").like("Brand#1|%"), 5).otherwise(v)).cast("double"))
    return N.good_samples_genes(x)


# --- pileups ------------------------------------------------------------------------------------------------------

#: CIGARs of the stand-in reads with their aligned blocks (offset in the reference, offset in the read, length).
CIGARS = {0: ("8M", [(0, 0, 8)]), 1: ("2S6M", [(0, 2, 6)]), 2: ("3M2D5M", [(0, 0, 3), (5, 3, 5)]), 3: ("4M1I3M", [(0, 0, 4), (4, 5, 3)]), 4: ("1H2=3N4X2S", [(0, 0, 2), (5, 2, 4)])}
_PICK = " ".join(f"WHEN {k} THEN '{c}'" for k, (c, _) in CIGARS.items())
_BLOCKS = ", ".join(f"({k}, {r}, {q}, {n})" for k, (_, bs) in CIGARS.items() for r, q, n in bs)
_READS = f"""rd AS (SELECT l_orderkey || '_' || l_linenumber AS qname, 'c' || (l_suppkey % 3) AS chr, l_partkey % 60 + 1 AS pos, CASE l_partkey % 5 {_PICK} END AS cigar, l_partkey % 5 AS kind,
  substr('ACGTNACGTACG', (l_linenumber % 4 + 1)::INT, 8) AS seq, substr('IIII5IIIIIII', (l_orderkey % 4 + 1)::INT, 8) AS qual, CASE WHEN l_quantity > 45 THEN 1123 WHEN l_quantity > 40 THEN 147 ELSE 99 END AS flag, CASE WHEN l_tax > 0.07 THEN 10 ELSE 60 END AS mapq FROM lineitem),
bl(kind, r, q, n) AS (VALUES {_BLOCKS}),
bs AS (SELECT qname, chr, pos + r + i AS position, substr(seq, (q + i + 1)::INT, 1) AS base, ascii(substr(qual, (q + i + 1)::INT, 1)) - 33 AS quality, flag, mapq FROM (SELECT *, unnest(range(n)) AS i FROM rd JOIN bl USING (kind)))"""


def _reads(spark, d):
    k = F.col("l_partkey") % 5
    cigar = F.element_at(F.create_map(*[x for i, (c, _) in CIGARS.items() for x in (F.lit(i).cast("bigint"), F.lit(c))]), k)
    cut = lambda text, n: F.substring(F.lit(text), (n % 4 + 1).cast("int"), F.lit(8))
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.concat("l_orderkey", F.lit("_"), "l_linenumber").alias("qname"), F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("chr"), (F.col("l_partkey") % 60).alias("pos"), cigar.alias("cigar"),
        cut("ACGTNACGTACG", F.col("l_linenumber")).alias("seq"), cut("IIII5IIIIIII", F.col("l_orderkey")).alias("qual"), F.when(q > 45, 1123).when(q > 40, 147).otherwise(99).alias("flag"),
        F.when(F.col("l_tax") > 0.07, 10).otherwise(60).alias("mapq"), F.lit(False).alias("has_sa"),
    )


@query(f"WITH {_READS} SELECT chr, position::BIGINT AS position, base, quality::INT AS quality, count(*) AS n FROM bs GROUP BY ALL")
def aligned_bases(spark, d):
    return U.aligned_bases(_reads(spark, d)).groupBy("chr", "position", "base", "quality").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_READS}, st AS (SELECT 'c' || (k % 4) AS chr, k // 4 * 3 AS position, substr('ACGT', (k % 4 + 1)::INT, 1) AS reference FROM range(120) t(k)), ok AS (SELECT * FROM bs WHERE flag IN (99, 147) AND mapq >= 20 AND quality >= 30),
n AS (SELECT chr, position, count(*) FILTER (base = 'A') AS count_A, count(*) FILTER (base = 'C') AS count_C, count(*) FILTER (base = 'G') AS count_G, count(*) FILTER (base = 'T') AS count_T FROM ok GROUP BY 1, 2)
SELECT st.*, coalesce(count_A, 0) AS count_A, coalesce(count_C, 0) AS count_C, coalesce(count_G, 0) AS count_G, coalesce(count_T, 0) AS count_T, coalesce(count_A + count_C + count_G + count_T, 0) AS coverage FROM st LEFT JOIN n USING (chr, position)""")
def targeted_pileup(spark, d):
    k = F.col("id")
    s = spark.range(120).select(F.concat(F.lit("c"), k % 4).alias("chr"), (F.floor(k / 4) * 3).alias("position"), F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1)).alias("reference"))
    return U.targeted_pileup(_reads(spark, d), s, 30, 20, 8)


@query(f"{COV}, n AS (SELECT count(*) AS n FROM frag), e AS (SELECT greatest(start, 2000) AS start, least(stop, 9000) AS stop, depth FROM cov WHERE chr = 'c3' AND start < 9000 AND stop > 2000), x AS (SELECT *, unnest(range(start // 100, (stop - 1) // 100 + 1)) AS k FROM e) SELECT k * 100 AS start, (k + 1) * 100 AS stop, round_even(sum((least(stop, (k + 1) * 100) - greatest(start, k * 100)) * depth) / 100.0 * 1e6 / any_value(n), 6) AS cpm FROM x, n GROUP BY k")
def region_coverage(spark, d):
    f = fragments(spark, d)
    n = f.agg(F.count(F.lit(1)).alias("n"))
    own = f.where("chr = 'c3' AND start < 9000 AND stop > 2000")
    b = I.bin_average(PD.region_track(I.coverage(own), "c3", 2000, 9000), 100).crossJoin(F.broadcast(n))
    return b.select("start", "stop", r6(F.col("score") * 1e6 / F.col("n")).alias("cpm"))


@query(f"{COV} SELECT chr, greatest(start, 2000) AS start, least(stop, 9000) AS stop, depth FROM cov WHERE chr = 'c3' AND start < 9000 AND stop > 2000")
def plot_coverage_track(spark, d):
    return PD.region_track(I.coverage(fragments(spark, d)), "c3", 2000, 9000)


# --- modules ------------------------------------------------------------------------------------------------------

MOD = "md AS (SELECT DISTINCT 'module_' || (p_size % 6) AS module, 'G' || (p_partkey % 400) || '.' || (p_size % 3) AS gene FROM part)"


def _modules(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("module_"), F.col("p_size") % 6).alias("module"), F.concat(F.lit("G"), F.col("p_partkey") % 400, F.lit("."), F.col("p_size") % 3).alias("gene")).distinct()


@query(f"WITH {MOD} SELECT module, list_sort(list_distinct(list(split_part(gene, '.', 1))))::VARCHAR AS genes, count(DISTINCT split_part(gene, '.', 1))::INT AS n FROM md WHERE module IN ('module_1', 'module_2', 'module_4') GROUP BY 1")
def cluster_genes(spark, d):
    x = D.cluster_genes(_modules(spark, d), ["module_0", "module_1", "module_2", "module_4"], strip=True)
    return x.withColumn("genes", F.concat(F.lit("["), F.array_join("genes", ", "), F.lit("]")))


@query(f"WITH {MOD} SELECT module, count(*) AS n FROM md GROUP BY 1")
def cluster_sizes(spark, d):
    return D.sizes(_modules(spark, d), "module")


@query("SELECT p_type AS grp, count(*) AS n_variables, count(*) FILTER (greatest(0, p_size - 45) <> 0) AS n_selected, count(*) FILTER (greatest(0, p_size - 45) <> 0) > 0 AS selected FROM part WHERE p_partkey % 3 = 1 GROUP BY 1")
def selected_variables(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.col("p_type").alias("grp"), (F.col("p_partkey") % 3 / 10.0).alias("lambda"), F.greatest(F.lit(0), F.col("p_size") - 45).alias("coefficient"))
    return D.selected_variables(c, 0.1)


CIR = f"""{MOD}, cl AS (SELECT DISTINCT 'C' || (l_suppkey % 4) AS cluster, 'G' || (l_partkey % 500) || '.1' AS gene FROM lineitem WHERE l_partkey % 500 % 4 = l_suppkey % 4), m1 AS (SELECT split_part(gene, '.', 1) AS k, min(module) AS module FROM md GROUP BY 1),
de1 AS (SELECT 'G' || (p_partkey % 400) || '.1' AS gene, avg(p_size) AS lfc FROM part GROUP BY 1), cg AS (SELECT cl.gene, cluster, module, lfc AS "log2FoldChange" FROM cl LEFT JOIN m1 ON split_part(cl.gene, '.', 1) = k LEFT JOIN de1 ON de1.gene = cl.gene)"""


def _circos(spark, d):
    k = F.col("l_partkey") % 500
    cl = table(spark, d, "lineitem").where(k % 4 == F.col("l_suppkey") % 4).select(F.concat(F.lit("C"), F.col("l_suppkey") % 4).alias("cluster"), F.concat(F.lit("G"), k, F.lit(".1")).alias("gene")).distinct()
    de = table(spark, d, "part").groupBy(F.concat(F.lit("G"), F.col("p_partkey") % 400, F.lit(".1")).alias("feature_id")).agg(F.avg("p_size").alias("log2FoldChange"))
    return D.overlap_genes(cl, _modules(spark, d), de)


@query(f'WITH {CIR} SELECT gene, cluster, module, round_even("log2FoldChange", 6) AS "log2FoldChange" FROM cg')
def module_overlap_genes(spark, d):
    return _circos(spark, d).select("gene", "cluster", "module", r6(F.col("log2FoldChange")).alias("log2FoldChange"))


@query(f"WITH {CIR} SELECT cluster, module, count(*) AS n FROM cg WHERE module IS NOT NULL GROUP BY 1, 2")
def module_overlap_counts(spark, d):
    return D.overlap_counts(_circos(spark, d))


@query(f"WITH {CIR}, t AS (SELECT module, count(*) AS size, (ascii(right(module, 1)) % 5) / 5.0 AS cor, ascii(right(module, 1)) % 2 = 0 AS sig FROM md GROUP BY 1), o AS (SELECT module, count(*) AS n FROM cg WHERE module IS NOT NULL GROUP BY 1) SELECT t.module, size, cor, sig, coalesce(n, 0) AS overlap FROM t LEFT JOIN o USING (module) WHERE t.module NOT IN ('grey', 'dummy', 'module_0') AND size >= 30 AND coalesce(n, 0) >= 1 AND cor >= 0.2 AND sig")
def modules_selected(spark, d):
    last = F.ascii(F.right("module", F.lit(1)))
    t = D.sizes(_modules(spark, d), "module").select("module", F.col("n").alias("size"), (last % 5 / 5.0).alias("cor"), (last % 2 == 0).alias("sig"))
    return D.select_modules(t, D.overlap_counts(_circos(spark, d)), 0.2)


@query(f"WITH {CIR} SELECT cluster, CASE WHEN module IN ('module_1', 'module_3') THEN module ELSE 'dummy' END AS module, count(*) AS n FROM cg GROUP BY 1, 2")
def modules_pooled(spark, d):
    s = spark.createDataFrame([("module_1",), ("module_3",)], "module string")
    return D.overlap_counts(D.pool_modules(_circos(spark, d), s))


@query(f"WITH {MOD} SELECT CASE module WHEN 'module_1' THEN 'blue' WHEN 'module_2' THEN 'red' END AS module, count(*) AS n FROM md GROUP BY module")
def modules_renamed(spark, d):
    return D.rename(D.sizes(_modules(spark, d), "module"), {"module_1": "blue", "module_2": "red"})


@query("SELECT l_partkey AS feature, sum(l_quantity) AS \"F1\" FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' GROUP BY 1")
def factor_signature(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature"), F.concat(F.lit("F"), "l_linenumber").alias("factor"), F.col("l_returnflag").alias("view")).agg(F.sum("l_quantity").alias("weight"))
    return D.factor_signature(w, "F1", "R")


@query("WITH p AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y, (a.n_nationkey * 7 + b.n_nationkey * 3) % 101 / 101.0 AS p FROM nation a, nation b) SELECT x, y, p, CASE WHEN p >= 0.05 THEN '' ELSE printf('%.2e', p) END AS text FROM p WHERE x < y")
def p_triangle(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("x"))
    p = n.crossJoin(n.withColumnRenamed("x", "y")).select("x", "y", ((F.col("x") * 7 + F.col("y") * 3) % 101 / F.lit(101.0)).alias("p"))
    return D.p_triangle(p)


@query("SELECT round(a.k, 6) AS a, round(b.k, 6) AS b FROM (SELECT 0.25 * i / 3 AS k FROM range(4) t(i)) a, (SELECT 0.85 + 0.15 * i / 3 AS k FROM range(4) t(i)) b")
def grid_fine(spark, d):
    rows = D.fine_grid(D.ranges_around([0.1, 1.0], 0.3), 4)
    return spark.createDataFrame([tuple(round(v, 6) for v in r) for r in rows], "a double, b double")


@query(f"WITH {CNT}, g AS (SELECT feature_id, sample_id, CASE WHEN value % 7 > 0 THEN value::DOUBLE END AS value FROM cnt), i AS (SELECT feature_id, sample_id, coalesce(value, avg(value) OVER (PARTITION BY feature_id)) AS value FROM g), z AS (SELECT sample_id, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM i WINDOW w AS (PARTITION BY feature_id)), d AS (SELECT sample_id, sqrt(sum(z * z)) AS distance FROM z GROUP BY 1) SELECT sample_id, round_even(distance, 5) AS distance, distance >= (SELECT avg(distance) + stddev_samp(distance) FROM d) AS outlier FROM d")
def sample_outliers(spark, d):
    c = counts(spark, d).withColumn("value", F.when(F.col("value") % 7 > 0, F.col("value").cast("double")))
    return D.sample_outliers(c, 11, 1.0).withColumn("distance", F.bround("distance", 5))


@query("SELECT v::INT AS view, s AS signal, CASE WHEN s THEN 25 * h ELSE 100 * n - 25 * h END AS n FROM (VALUES (1, 500, 50), (2, 1000, 50), (3, 750, 40)) t(v, n, h), (VALUES (true), (false)) u(s)")
def simulated_views(spark, d):
    return D.simulate_views(spark).groupBy("view", "signal").agg(F.count(F.lit(1)).alias("n"))


# --- markers, lists and exports -------------------------------------------------------------------------------------


@query(f"""WITH pw AS ({ORACLE_SQL["pairwise_markers"]}), g AS (SELECT cluster_a AS cluster, gene, avg(auc) AS mean_auc, min(auc) AS min_auc, median(auc) AS median_auc, max(auc) AS max_auc, avg(cohens_d) AS mean_cohens_d, avg(detected_lfc) AS mean_detected_lfc FROM pw GROUP BY 1, 2)
SELECT cluster, gene, round_even(mean_auc, 5) AS mean_auc, min_auc, round_even(median_auc, 5) AS median_auc, max_auc, round_even(mean_cohens_d, 5) AS mean_cohens_d, round_even(mean_detected_lfc, 5) AS mean_detected_lfc, row_number() OVER (PARTITION BY cluster ORDER BY round(mean_auc, 9) DESC, gene)::INT AS rank FROM g WHERE mean_auc >= 0.45 QUALIFY rank <= 3""")
def marker_scores(spark, d):
    x = D.score_markers(pairwise_markers(spark, d), 0.45, 3)
    five = ("mean_auc", "median_auc", "mean_cohens_d", "mean_detected_lfc")
    return x.withColumns({c: F.bround(c, 5) for c in five})


@query(f"""WITH {DE}, l AS (SELECT comparison, CASE WHEN "log2FoldChange" > 0.02 THEN 'up' ELSE 'down' END AS direction, feature_id AS gene FROM de WHERE pvalue < 0.6 AND abs("log2FoldChange") > 0.02), k AS (SELECT comparison, direction FROM l GROUP BY 1, 2 HAVING count(DISTINCT gene) >= 3),
h AS (SELECT DISTINCT l.* FROM l JOIN k USING (comparison, direction)), s AS (SELECT DISTINCT split_part(feature_id, '|', 2) AS set_id, feature_id AS gene FROM de), u AS (SELECT DISTINCT comparison, feature_id AS gene FROM de),
z AS (SELECT comparison, set_id, count(*) AS set_size FROM s JOIN u USING (gene) GROUP BY 1, 2), t AS (SELECT comparison, count(*) AS n_universe FROM u GROUP BY 1), n AS (SELECT comparison, direction, count(*) AS n_hits FROM h GROUP BY 1, 2), o AS (SELECT comparison, direction, set_id, count(*) AS overlap FROM h JOIN s USING (gene) GROUP BY 1, 2, 3)
SELECT comparison, direction, set_id, n_hits, set_size, n_universe, coalesce(overlap, 0) AS overlap, round_even(coalesce(overlap, 0) * (n_universe - set_size - n_hits + coalesce(overlap, 0)) / ((set_size - coalesce(overlap, 0)) * (n_hits - coalesce(overlap, 0)) + 1e-10), 6) AS odds_ratio FROM n JOIN z USING (comparison) JOIN t USING (comparison) LEFT JOIN o USING (comparison, direction, set_id)""")
def ora_per_comparison(spark, d):
    de = results(spark, d).withColumnRenamed("pvalue", "padj")
    lists = X.directions(de, "comparison", 0.02, 0.6, 3)
    sets = de.select(F.split("feature_id", "\\|")[1].alias("set_id"), F.col("feature_id").alias("gene"))
    x = X.over_representation_by(lists, sets, de.select("comparison", F.col("feature_id").alias("gene")), ["comparison", "direction"])
    return x.withColumn("odds_ratio", r6(F.col("odds_ratio")))


@query(f"WITH q AS ({ORACLE_SQL['gsea_per_comparison']}), {DE}, n AS (SELECT comparison, count(DISTINCT feature_id) FILTER (comparison <> 'y1') AS n_ranked FROM de GROUP BY 1) SELECT comparison, set_id, size, es, n_ranked FROM q JOIN n USING (comparison) WHERE comparison <> 'y1' UNION ALL SELECT comparison, NULL, NULL, NULL, n_ranked FROM n WHERE n_ranked < 10")
def gsea_with_skips(spark, d):
    de = results(spark, d)
    ranked = de.select("comparison", F.col("feature_id").alias("gene"), F.when(F.col("comparison") != "y1", F.col("log2FoldChange")).alias("stat"))
    sets = de.select(F.split("feature_id", "\\|")[1].alias("set_id"), F.col("feature_id").alias("gene"))
    return X.gsea_by(ranked, sets, "comparison").withColumn("es", r6(F.col("es")))


@query(f"""WITH {EXPR}, {LOGX}, n AS (SELECT label, count(*) AS n FROM cel WHERE label IS NOT NULL GROUP BY 1), s AS (SELECT gene, label, sum(logcounts) AS s FROM lx JOIN cel USING (cell) WHERE label IS NOT NULL GROUP BY 1, 2), m AS (SELECT g.gene, n.label, round_even(coalesce(s, 0) / n, 4) + 0.0 AS m FROM (SELECT DISTINCT gene FROM lx) g CROSS JOIN n LEFT JOIN s ON s.gene = g.gene AND s.label = n.label)
SELECT gene, round(sum(m * (ascii(right(label, 1)) - 47)), 4) AS checksum, count(*) AS n_levels FROM m GROUP BY 1""")
def expression_by_level(spark, d):
    x = X.mean_by_level(C.log_normalize(expression(spark, d)), cell_table(spark, d), "label")
    m = F.from_json("means", "map<string,double>")
    total = F.aggregate(F.map_entries(m), F.lit(0.0), lambda a, e: a + e["value"] * (F.ascii(F.right(e["key"], F.lit(1))) - 47))
    return x.select("gene", F.round(total, 4).alias("checksum"), F.size(m).cast("bigint").alias("n_levels"))


def new_folder(spark, label: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{label}-{os.urandom(8).hex()}" if base else tempfile.mkdtemp(prefix=f"{label}-")


SIG_CUT = 'pvalue < 0.3 AND abs("log2FoldChange") >= 0.05'
_EXPORT = {"all": "true", "significant": SIG_CUT, "up": SIG_CUT + ' AND "log2FoldChange" > 0', "down": SIG_CUT + ' AND "log2FoldChange" < 0'}


@query(f"WITH {DE} " + " UNION ALL ".join(f"SELECT '{n}' AS part, comparison, count(*) AS n, round_even(sum(\"log2FoldChange\"), 4) + 0.0 AS s FROM de WHERE {c} GROUP BY 2" for n, c in _EXPORT.items()))
def results_exported(spark, d):
    folder = new_folder(spark, "results")
    W.result_set(results(spark, d), folder, ["comparison"], "pvalue", 0.3, 0.05)
    out = None
    for name in _EXPORT:
        x = R.result_set(spark, folder, name).groupBy(F.lit(name).alias("part"), "comparison").agg(F.count(F.lit(1)).alias("n"), (F.bround(F.sum(F.col("log2FoldChange").cast("double")), 4) + 0.0).alias("s"))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"WITH {DE} SELECT DISTINCT 'one' AS experiment, feature_id AS gene FROM de WHERE comparison IN ('y0', 'y1') AND {SIG_CUT} UNION SELECT DISTINCT 'two', feature_id FROM de WHERE comparison IN ('y2', 'y3') AND {SIG_CUT}")
def gene_lists_loaded(spark, d):
    de, folders = results(spark, d), {}
    for name, own in (("one", ["y0", "y1"]), ("two", ["y2", "y3"])):
        folders[name] = new_folder(spark, "lists")
        W.result_set(de.where(F.col("comparison").isin(own)), folders[name], ["comparison"], "pvalue", 0.3, 0.05)
    return R.gene_lists(spark, folders)


@query(f"WITH {EXPR}, g AS (SELECT gene, row_number() OVER (ORDER BY gene) AS gene_no FROM (SELECT DISTINCT gene FROM expr)), c AS (SELECT cell, row_number() OVER (ORDER BY cell) AS cell_no FROM (SELECT DISTINCT cell FROM expr)) SELECT gene_no::INT AS gene_no, cell_no::INT AS cell_no, counts FROM expr JOIN g USING (gene) JOIN c USING (cell)")
def matrix_triplets(spark, d):
    folder = new_folder(spark, "triplets")
    W.triplets(expression(spark, d), folder)
    return spark.read.schema("gene_no int, cell_no int, counts bigint").option("sep", " ").csv(f"{folder}/matrix")


# --- frames behind plots ---------------------------------------------------------------------------------------------


@query("WITH v AS (SELECT 'k' || (o_orderkey % 3) AS k, (o_orderkey % 101) / 101.0 AS v FROM orders), g AS (SELECT DISTINCT k, i FROM v, range(21) t(i)) SELECT g.k, i / 20.0 AS x, round_even(count(v.v) FILTER (ceil(round(v.v * 20, 9)) <= i) / count(v.v)::DOUBLE, 6) AS share FROM g JOIN v USING (k) GROUP BY 1, 2")
def plot_ecdf(spark, d):
    v = table(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey") % 3).alias("k"), (F.col("o_orderkey") % 101 / F.lit(101.0)).alias("v"))
    return PD.ecdf(v, "v", ["k"], 20).withColumn("share", r6(F.col("share")))


@query("WITH c AS (SELECT k, i / 10.0 AS x, pow(i / 10.0, k) AS share FROM range(1, 6) a(k), range(11) b(i)), p AS (SELECT k, (x - lag(x) OVER (PARTITION BY k ORDER BY x)) * share AS p FROM c), a AS (SELECT k, sum(p) AS area FROM p GROUP BY 1) SELECT k, round_even(area, 6) AS area, round_even(coalesce((area - lag(area) OVER (ORDER BY k)) / lag(area) OVER (ORDER BY k), area), 6) AS delta FROM a")
def plot_delta_area(spark, d):
    c = spark.range(1, 6).withColumnRenamed("id", "k").crossJoin(spark.range(11)).select("k", (F.col("id") / 10.0).alias("x"), F.pow(F.col("id") / 10.0, F.col("k").cast("double")).alias("share"))
    return PD.delta_area(c).withColumns({"area": r6(F.col("area")), "delta": r6(F.col("delta"))})


@query(f"""WITH {DE} SELECT *, CASE WHEN "log2FoldChange" > 0 THEN 'up' ELSE 'down' END AS side, row_number() OVER (PARTITION BY comparison, "log2FoldChange" > 0 ORDER BY abs("log2FoldChange") DESC, feature_id)::INT AS rank FROM de WHERE "log2FoldChange" <> 0 QUALIFY rank <= 5""")
def plot_waterfall(spark, d):
    return PD.waterfall(results(spark, d), 5)


@query(f"""WITH {DE}, a AS (SELECT feature_id, "log2FoldChange" AS x FROM de WHERE comparison = 'y0'), b AS (SELECT feature_id, "log2FoldChange" AS y FROM de WHERE comparison = 'y1') SELECT feature_id, x, y, CASE WHEN x >= 0 THEN '+' ELSE '-' END || CASE WHEN y >= 0 THEN '+' ELSE '-' END AS quadrant FROM a JOIN b USING (feature_id)""")
def plot_scatter_pairs(spark, d):
    de = results(spark, d)
    return PD.joined_scatter(de.where("comparison = 'y0'"), de.where("comparison = 'y1'"), "feature_id", "log2FoldChange", "log2FoldChange")


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_type, n, round_even(n / sum(n) OVER (PARTITION BY p_brand), 6) AS share, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type)::INT AS rank FROM c")
def plot_stacked_shares(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return PD.shares(c, "p_brand", "p_type").withColumn("share", r6(F.col("share")))


@query(f"{NET}, a AS (SELECT 'wsum' AS method, source, sample_id, sum(value * mor) AS score FROM cnt JOIN net ON feature_id = target GROUP BY 2, 3 UNION ALL SELECT 'wmean', source, sample_id, sum(value * mor) / nullif(sum(abs(mor)), 0) FROM cnt JOIN net ON feature_id = target GROUP BY 2, 3) SELECT a.method AS x, b.method AS y, count(*) AS n, round_even(corr(a.score, b.score), 5) AS r, round_even(avg((sign(a.score) = sign(b.score))::INT), 6) AS same_sign FROM a JOIN a b ON a.source = b.source AND a.sample_id = b.sample_id AND a.method < b.method GROUP BY 1, 2")
def plot_method_agreement(spark, d):
    c = counts(spark, d)
    n = _net(c)
    m = [X.activity(c, n, k, 1).select(F.lit(k).alias("method"), "source", "sample_id", "score") for k in ("wsum", "wmean")]
    return PD.method_agreement(m[0].unionAll(m[1])).withColumns({"r": F.bround("r", 5), "same_sign": r6(F.col("same_sign"))})


@query(f"WITH {CNT}, {SAM}, z AS (SELECT feature_id, sample_id, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM cnt WINDOW w AS (PARTITION BY feature_id)), f AS (SELECT feature_id, grp, batch, avg(z) AS z FROM z JOIN sam USING (sample_id) GROUP BY 1, 2, 3) SELECT split_part(feature_id, '|', 2) AS cluster, grp, batch, round_even(avg(z), 6) + 0.0 AS mean, round_even(stddev_samp(z) / sqrt(count(z)), 6) AS sem, count(z) AS n_features FROM f GROUP BY 1, 2, 3")
def plot_cluster_profiles(spark, d):
    c = counts(spark, d)
    cl = c.select("feature_id", F.split("feature_id", "\\|")[1].alias("cluster")).distinct()
    return PD.cluster_profiles(c, cl, samples(spark), ["grp", "batch"]).withColumns({"mean": r6(F.col("mean")) + 0.0, "sem": r6(F.col("sem"))})


@query("WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS c_acctbal, avg(c_nationkey) AS c_nationkey FROM customer GROUP BY 1), u AS (SELECT c_mktsegment, 'c_acctbal' AS variable, c_acctbal AS mean FROM m UNION ALL SELECT c_mktsegment, 'c_nationkey', c_nationkey FROM m) SELECT c_mktsegment, variable, round_even(mean, 6) AS mean, round_even((mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w), 6) AS scaled FROM u WINDOW w AS (PARTITION BY variable)")
def plot_radar(spark, d):
    return PD.radar(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]).withColumns({"mean": r6(F.col("mean")), "scaled": r6(F.col("scaled"))})


@query("WITH l AS (SELECT p_brand AS component, p_type AS variable, avg(p_size) - 25 AS loading FROM part GROUP BY 1, 2), c AS (SELECT *, loading * loading / sum(loading * loading) OVER (PARTITION BY component) AS c FROM l) SELECT component, variable, round_even(loading, 6) + 0.0 AS loading, round_even(c, 6) AS contribution, row_number() OVER (PARTITION BY component ORDER BY round(c, 9) DESC, variable)::INT AS rank FROM c")
def plot_contributions(spark, d):
    x = table(spark, d, "part").groupBy(F.col("p_brand").alias("component"), F.col("p_type").alias("variable")).agg((F.avg("p_size") - 25).alias("loading"))
    return PD.contributions(x).withColumns({"loading": r6(F.col("loading")) + 0.0, "contribution": r6(F.col("contribution"))})


@query("SELECT p_brand AS module, p_name || p_partkey AS term, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_name || p_partkey)::INT AS rank FROM part QUALIFY rank <= 4")
def plot_top_bars(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("module"), F.concat("p_name", "p_partkey").alias("term"), F.col("p_size").alias("size"))
    return PD.top_bars(t, ["module"], "size", "term", 4, True)


@query("WITH w AS (SELECT l_returnflag AS view, 'F' || l_linenumber AS factor, sum(l_quantity * l_quantity) AS s FROM lineitem GROUP BY 1, 2) SELECT view, factor, round_even(s / sum(s) OVER (PARTITION BY view), 6) AS share FROM w")
def plot_variance_explained(spark, d):
    w = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("view"), F.concat(F.lit("F"), "l_linenumber").alias("factor"), F.col("l_partkey").alias("feature"), F.col("l_quantity").alias("weight"))
    return PD.variance_explained(w).withColumn("share", r6(F.col("share")))


@query(f"WITH {FRAG}, g AS (SELECT chr, count(*) AS n FROM frag GROUP BY 1) SELECT chr, n, round_even(n / sum(n) OVER (), 6) AS share FROM g")
def plot_chromosome_shares(spark, d):
    g = fragments(spark, d).groupBy("chr").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1))
    return PD.shares(g, "all", "chr").select("chr", "n", r6(F.col("share")).alias("share"))


@query(f"{COR}, r AS (SELECT x, y, count(*) AS n, corr(u, v) AS r FROM p GROUP BY 1, 2 HAVING count(*) >= 3) SELECT x, y, n, round_even(r, 6) AS r FROM r WHERE abs(r) > 0.02")
def collinear_pairs(spark, d):
    from ..operators import quality as Q

    return Q.collinear(T.correlation_pairs(correlation_values(spark, d)), 0.02).withColumn("r", r6(F.col("r")))
