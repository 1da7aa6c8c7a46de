"""Queries of the smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import cells as C
from ..operators import editing as E
from ..operators import models as M
from ..operators import plotdata as PD
from ..operators import quality as Q
from ..operators import stats as T
from ..operators import values as V
from .catalog import CNT, DE, EXPR, ORACLE_SQL, SAM, _metrics, METR, cell_table, counts, enrichment_test, motif_rates, ora_counts, pairwise_markers, query, r6, results, samples, table, transitions


@query("SELECT DISTINCT 'G' || (l_partkey % 200) AS gene FROM lineitem WHERE l_partkey % 200 > 4")
def gene_list(spark, d):
    k = F.col("l_partkey") % 200
    x = table(spark, d, "lineitem").select(F.when(k > 4, F.concat(F.lit("G"), k, F.lit("."), F.col("l_partkey") % 3)).when(k > 2, F.lit("  ")).alias("gene"))
    return A.gene_list(x)


@query(f"WITH pw AS ({ORACLE_SQL['pairwise_markers']}) SELECT gene, round_even(auc - 0.5, 6) + 0.0 AS stat FROM pw WHERE cluster_a = 'k0' AND cluster_b = 'k2'")
def ranked_pair(spark, d):
    return A.rank_pairs(pairwise_markers(spark, d), "k0", "k2").withColumn("stat", r6(F.col("stat")) + 0.0)


@query(f"WITH {EXPR}, m AS (SELECT 'click' || k AS gene, min('CLICK' || (k + j)) AS ortholog FROM range(60) t(k), range(2) u(j) GROUP BY 1) SELECT e.gene, cell, counts, ortholog FROM expr e JOIN m USING (gene)")
def orthologs_mapped(spark, d):
    from .catalog import expression

    m = spark.range(60).crossJoin(spark.range(2).withColumnRenamed("id", "j")).select(F.concat(F.lit("click"), "id").alias("gene"), F.concat(F.lit("CLICK"), F.col("id") + F.col("j")).alias("ortholog"))
    return A.orthologs(expression(spark, d), m)


@query(f"""WITH {DE} SELECT comparison AS cluster, count(*) AS n_tested, count(*) FILTER (pvalue < 0.05) AS n_sig, count(*) FILTER (pvalue < 0.05 AND "log2FoldChange" > 0) AS n_up, count(*) FILTER (pvalue < 0.05 AND "log2FoldChange" < 0) AS n_down FROM de GROUP BY 1""")
def results_summarised(spark, d):
    return A.summarise_results(results(spark, d).withColumnRenamed("comparison", "cluster").withColumnRenamed("pvalue", "padj"))


@query(f"WITH r AS ({ORACLE_SQL['motif_rates']}) SELECT sample_id, max(pooled_rate) FILTER (grp = 'target') AS target_rate, max(pooled_rate) FILTER (grp = 'control') AS control_rate, round_even(max(pooled_rate) FILTER (grp = 'target') / nullif(max(pooled_rate) FILTER (grp = 'control'), 0), 6) AS ratio FROM r GROUP BY 1")
def motif_rate_ratio(spark, d):
    return E.motif_enrichment(motif_rates(spark, d)).withColumn("ratio", r6(F.col("ratio")))


@query(f"WITH {EXPR} SELECT sample_id, count(*) AS n, count(*) FILTER (cell % 9 = 0) AS n_doublets, round_even(count(*) FILTER (cell % 9 = 0) / count(*)::DOUBLE, 6) AS rate FROM cel GROUP BY 1")
def doublet_rates(spark, d):
    c = cell_table(spark, d).withColumn("doublet_class", F.when(F.col("cell") % 9 == 0, "doublet").otherwise("singlet"))
    return C.doublet_rates(c).withColumn("rate", r6(F.col("rate")))


@query("WITH v AS (SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'Pool_' ELSE 's' END || l_suppkey AS sample_id, 'p' || (l_partkey % 30) AS feature_id, l_quantity AS value FROM lineitem) SELECT feature_id, round_even(stddev_samp(value) / nullif(avg(value), 0), 6) AS cv, count(value) AS n FROM v WHERE lower(sample_id) LIKE 'pool%' GROUP BY 1")
def pool_variation(spark, d):
    k = F.col("l_suppkey")
    v = table(spark, d, "lineitem").select(F.concat(F.when(k % 5 == 0, "Pool_").otherwise("s"), k).alias("sample_id"), F.concat(F.lit("p"), F.col("l_partkey") % 30).alias("feature_id"), F.col("l_quantity").alias("value"))
    return Q.pool_cv(v).withColumn("cv", r6(F.col("cv")))


@query(f"WITH g AS ({ORACLE_SQL['global_shift']}) SELECT feature_id, round_even((log2(mean_a + 1) + log2(mean_b + 1)) / 2, 5) AS average, round_even(log2(mean_b + 1) - log2(mean_a + 1), 5) + 0.0 AS difference FROM g")
def plot_ma(spark, d):
    from .catalog import global_shift

    return PD.ma(global_shift(spark, d)).select("feature_id", F.bround("average", 5).alias("average"), (F.bround("difference", 5) + 0.0).alias("difference"))


@query("SELECT k::INT AS component, 1.0 / (k * (k + 1)) AS explained, round_even(sum(1.0 / (k * (k + 1))) OVER (ORDER BY k), 6) AS cumulative FROM range(1, 9) t(k)")
def plot_scree(spark, d):
    k = F.col("id").cast("double")
    x = spark.range(1, 9).select(F.col("id").cast("int").alias("component"), (1.0 / (k * (k + 1))).alias("explained"))
    return PD.scree(x).withColumn("cumulative", r6(F.col("cumulative")))


@query(f"WITH t AS ({ORACLE_SQL['transitions']}) SELECT step || ':' || \"from\" AS source, (step + 1) || ':' || \"to\" AS target, n AS value FROM t")
def plot_sankey(spark, d):
    return PD.sankey(transitions(spark, d))


@query(f"WITH o AS ({ORACLE_SQL['ora_counts']}), p AS (SELECT *, (set_size * 7 % 31) / 31.0 AS padj FROM o) SELECT row_number() OVER (ORDER BY padj, set_id)::INT AS rank, set_id, padj, round_even(overlap / set_size::DOUBLE, 6) AS gene_ratio FROM p QUALIFY rank <= 12")
def plot_enrichment_dots(spark, d):
    x = ora_counts(spark, d).withColumn("padj", F.col("set_size") * 7 % 31 / F.lit(31.0))
    return PD.enrichment_dots(x, 12).withColumn("gene_ratio", r6(F.col("gene_ratio")))


@query(f"WITH {CNT}, {SAM} SELECT feature_id, grp, batch AS timepoint, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value) / sqrt(count(value)), 6) AS sem, count(value) AS n FROM cnt JOIN sam USING (sample_id) GROUP BY 1, 2, 3")
def plot_time_course(spark, d):
    x = PD.time_course(counts(spark, d), samples(spark).withColumnRenamed("batch", "timepoint"))
    return x.withColumns({"mean": r6(F.col("mean")), "sem": r6(F.col("sem"))})


@query(f"{METR} SELECT *, coalesce(sum >= 40 AND sum <= 90 AND detected >= 30 AND pct_err <= 30, false) AS keep FROM m")
def cell_filter_fixed(spark, d):
    return C.filter_fixed(_metrics(spark, d), sum=(40, 90), detected=(30, None), pct_err=(None, 30))


@query(f"WITH {CNT}, f AS ({ORACLE_SQL['size_factors']}) SELECT feature_id, sample_id, round_even(value / size_factor, 4) AS value FROM cnt JOIN f USING (sample_id)")
def counts_normalized(spark, d):
    c = counts(spark, d)
    f = V.size_factors(c).withColumn("size_factor", r6(F.col("size_factor")))
    return V.normalize(c, f).withColumn("value", F.bround("value", 4))


@query(f"WITH {CNT}, x AS (SELECT feature_id, sample_id, CASE WHEN value % 3 > 0 THEN value::DOUBLE END AS value FROM cnt) SELECT * FROM x WHERE feature_id IN (SELECT feature_id FROM x GROUP BY 1 HAVING avg((value IS NULL)::INT) <= 0.3)")
def drop_missing(spark, d):
    c = counts(spark, d).withColumn("value", F.when(F.col("value") % 3 > 0, F.col("value").cast("double")))
    return V.drop_missing(c, "feature_id", 0.3)


@query(f"WITH {CNT}, x AS (SELECT feature_id, sample_id, CASE WHEN value % 7 > 0 THEN value::DOUBLE END AS value FROM cnt) SELECT feature_id, sample_id, coalesce(value, min(value) OVER (PARTITION BY feature_id) / 2) AS value FROM x")
def impute_half_min(spark, d):
    c = counts(spark, d).withColumn("value", F.when(F.col("value") % 7 > 0, F.col("value").cast("double")))
    return V.impute(c, "half_min")


@query(f"WITH {DE} SELECT feature_id, comparison, round_even(least(1, pvalue * count(*) OVER (PARTITION BY comparison)), 6) AS padj FROM de")
def bonferroni_adjust(spark, d):
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("comparison"))
    return results(spark, d).select("feature_id", "comparison", r6(T.bonferroni(F.col("pvalue"), n)).alias("padj"))


_DUP = """al AS (SELECT 'r' || (o_orderkey // 2) AS qname, 'c' AS chr, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 % 40 ELSE o_orderkey // 2 % 40 + 50 + o_orderkey // 2 % 3 END AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 99 ELSE 147 END AS flag, substr('!+5?I', (o_custkey % 4 + 1)::INT, 2) AS qual FROM orders)"""


@query(f"""WITH {_DUP}, t AS (SELECT qname, list_sort(list([pos, flag & 16])) AS ends, sum(ascii(qual[1]) + ascii(qual[2]) - 66) AS q FROM al GROUP BY 1), d AS (SELECT qname, row_number() OVER (PARTITION BY ends ORDER BY q DESC, qname) > 1 AS duplicate FROM t) SELECT qname, pos, flag, duplicate FROM al JOIN d USING (qname)""")
def duplicates_marked(spark, d):
    k, h = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 2)
    first = k % 2 == 0
    al = table(spark, d, "orders").select(
        F.concat(F.lit("r"), h).alias("qname"), F.lit("c").alias("chr"), F.when(first, h % 40).otherwise(h % 40 + 50 + h % 3).alias("pos"), F.when(first, 99).otherwise(147).alias("flag"),
        F.substring(F.lit("!+5?I"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(2)).alias("qual"),
    )
    return E.mark_duplicates(al).select("qname", "pos", "flag", "duplicate")


# --- tests whose tails SQL can sum, and fits up to their statistics ------------------------------------------------

_LC = "lgamma({n} + 1) - lgamma({r} + 1) - lgamma({n} - {r} + 1)"
_TERM = _LC.format(n="set_size", r="i") + " + " + _LC.format(n="(n_universe - set_size)", r="(n_hits - i)") + " - (" + _LC.format(n="n_universe", r="n_hits") + ")"


@query(f"""WITH o AS ({ORACLE_SQL['ora_counts']}), e AS (SELECT *, unnest(range(overlap, least(set_size, n_hits) + 1)) AS i FROM o), p AS (SELECT set_id, least(1, sum(exp({_TERM}))) AS pvalue FROM e WHERE n_hits - i <= n_universe - set_size GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY pvalue) AS k, count(*) OVER () AS m FROM p) SELECT set_id, round_even(pvalue, 6) AS pvalue, round_even(least(1, min(pvalue * m / k) OVER (ORDER BY pvalue DESC, k DESC ROWS UNBOUNDED PRECEDING)), 5) AS padj FROM r""")
def enrichment_tails(spark, d):
    x = enrichment_test(spark, d)
    return x.select("set_id", r6(F.col("pvalue")).alias("pvalue"), F.bround("padj", 5).alias("padj"))


@query(f"""WITH {CNT}, {SAM}, v AS (SELECT feature_id, log2(value + 1) AS y, (grp = 'b')::INT::DOUBLE AS a, batch::DOUBLE AS b FROM cnt JOIN sam USING (sample_id)),
s AS (SELECT feature_id, count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS b_y, covar_pop(y, y) AS yy FROM v GROUP BY 1),
f AS (SELECT *, (bb * ay - ab * b_y) / (aa * bb - ab * ab) AS ca, (aa * b_y - ab * ay) / (aa * bb - ab * ab) AS cb FROM s),
e AS (SELECT *, n * (yy - ca * ay - cb * b_y) / (n - 3) AS s2 FROM f)
SELECT feature_id, 'grp_b' AS term, round_even(ca, 5) + 0.0 AS estimate, round_even(sqrt(s2 * bb / (n * (aa * bb - ab * ab))), 5) AS std_error, round_even(ca / sqrt(s2 * bb / (n * (aa * bb - ab * ab))), 4) + 0.0 AS stat FROM e
UNION ALL SELECT feature_id, 'batch', round_even(cb, 5) + 0.0, round_even(sqrt(s2 * aa / (n * (aa * bb - ab * ab))), 5), round_even(cb / sqrt(s2 * aa / (n * (aa * bb - ab * ab))), 4) + 0.0 FROM e""")
def ols_statistics(spark, d):
    from .catalog import ols_fits

    x = ols_fits(spark, d).where("term <> 'intercept'")
    return x.select("feature_id", "term", (F.bround("estimate", 5) + 0.0).alias("estimate"), F.bround("std_error", 5).alias("std_error"), (F.bround("stat", 4) + 0.0).alias("stat"))


@query("WITH x AS (SELECT generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT 64 AS components, round_even(sum(v), 5) AS total FROM (SELECT var_samp(v) AS v FROM x GROUP BY dim)")
def pca_total_variance(spark, d):
    """All components together have the variance of all dimensions."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    s = M.pca(e, 64).groupBy("component").agg(F.var_samp("score").alias("v"))
    return s.agg(F.count(F.lit(1)).cast("int").alias("components"), F.bround(F.sum("v"), 5).alias("total"))
