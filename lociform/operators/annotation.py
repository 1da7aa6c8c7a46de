"""Identifier maps, networks, ranked lists, labels and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import strip_version


def rename_chromosomes(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename by a map; what it does not hold keeps its name."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn("chr", F.coalesce(F.element_at(F.create_map(*pairs), F.col("chr")), "chr") if pairs else F.col("chr"))


def first_match(table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return table.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def convert_ids(df: DataFrame, mapping: DataFrame, column: str = "gene") -> DataFrame:
    """Version-stripped ids to names by first match, the stripped id where there is none; later uses of a name get .1, .2."""
    m = first_match(mapping.select(strip_version(F.col("id")).alias("__id"), "name"), "__id", [F.col("name")])
    x = df.withColumn("__id", strip_version(F.col(column))).join(m, "__id", "left").withColumn("name", F.coalesce("name", "__id"))
    n = F.row_number().over(Window.partitionBy("name").orderBy(column)) - 1
    return x.withColumn("name", F.when(n > 0, F.concat("name", F.lit("."), n)).otherwise(F.col("name"))).drop("__id")


def gene_list(df: DataFrame, column: str = "gene", strip: bool = True) -> DataFrame:
    c = strip_version(F.col(column)) if strip else F.col(column)
    return df.select(c.alias(column)).where(F.col(column).isNotNull() & (F.trim(column) != "")).distinct()


def rank_from_results(results: DataFrame, metric: str = "signed_p") -> DataFrame:
    """Ranked list (gene, stat): stat, lfc or sign x -log10 p; NULLs drop, the strongest entry of a gene stays."""
    m = {"stat": F.col("stat") if "stat" in results.columns else F.lit(None), "lfc": F.col("log2FoldChange"), "signed_p": -F.signum("log2FoldChange") * F.log10(F.greatest(F.col("pvalue"), F.lit(1e-300)))}[metric]
    x = results.select(F.col("feature_id").alias("gene"), m.cast("double").alias("stat")).where("stat IS NOT NULL")
    return first_match(x, "gene", [F.abs("stat").desc(), F.col("stat").desc()])


def filter_enrichment(table: DataFrame, n: int, p_cut: float | None = None, sources: list[str] | None = None) -> DataFrame:
    """Best terms per (module, source) by p, ties by term."""
    x = table if sources is None else table.where(F.col("source").isin(sources))
    x = x if p_cut is None else x.where(F.col("pvalue") <= p_cut)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("module", "source").orderBy("pvalue", "term"))).where(F.col("rank") <= n)


def interactions(edges: DataFrame, genes: DataFrame, least_sources: int = 1) -> DataFrame:
    """Undirected edges with both ends in the set, no loops, the best-supported copy of each."""
    a, b = genes.select(F.col("gene").alias("source")), genes.select(F.col("gene").alias("target"))
    x = edges.join(a, "source", "left_semi").join(b, "target", "left_semi").where((F.col("source") != F.col("target")) & (F.col("n_resources") >= least_sources))
    return x.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("n_resources").alias("n_resources"))


def assign_labels(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Cluster labels by left join; clusters without one get NULL."""
    return cells.join(first_match(labels, "cluster", [F.col("label")]).select("cluster", F.col("label").alias("assigned")), "cluster", "left")


def to_saf(peaks: DataFrame) -> DataFrame:
    return peaks.select(F.col("peak_id").alias("GeneID"), F.col("chr").alias("Chr"), (F.col("start") + 1).alias("Start"), F.col("stop").alias("End"), F.lit(".").alias("Strand"))


def summit_windows(peaks: DataFrame, half: int) -> DataFrame:
    """Windows around summits; peaks without one (NULL or negative) drop."""
    s = F.col("start") + F.col("peak_summit")
    return peaks.where("peak_summit >= 0").select("name", "chr", F.greatest(F.lit(0), s - half).alias("start"), (s + half).alias("stop"))


def filter_motifs(motifs: DataFrame, q: float = 0.05, p: float | None = None, least_target: float = 0.0, n: int | None = None) -> DataFrame:
    """By p where a bound on it is given, else by q; then the share of targets, then the best n of each set."""
    x = motifs.where((F.col("pvalue") <= p) if p is not None else (F.col("qvalue") <= q)).where(F.col("pct_target") >= least_target)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("qvalue", "motif")))
    return x if n is None else x.where(F.col("rank") <= n)


def quantification_summary(values: DataFrame) -> DataFrame:
    return values.groupBy("sample_id").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count_if(F.col("value") > 0).alias("n_detected"))


def densify(values: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """All features by all samples, absent values 0."""
    grid = features.select("feature_id").distinct().crossJoin(F.broadcast(samples.select("sample_id").distinct()))
    return grid.join(values, ["feature_id", "sample_id"], "left").na.fill(0, ["value"])


def sheet_summary(sheet: DataFrame) -> DataFrame:
    """Rows by omics, group, batch and omics x group, with distinct biological replicates."""
    g = sheet.groupingSets([["omics"], ["group"], ["batch"], ["omics", "group"]], "omics", "group", "batch")
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bio_rep").alias("n_bio_reps"))


def isoform_shares(values: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, sample_id, value) with the transcript's share of its gene."""
    w = Window.partitionBy("gene_id", "sample_id")
    return values.withColumn("share", F.try_divide(F.col("value"), F.sum("value").over(w)))


def isoform_switch(values: DataFrame, samples: DataFrame, a: str, b: str) -> DataFrame:
    """Mean share per group and their difference."""
    x = isoform_shares(values).join(samples.select("sample_id", "grp"), "sample_id")
    g = x.groupBy("gene_id", "transcript_id").agg(F.avg(F.when(F.col("grp") == a, F.col("share"))).alias("share_a"), F.avg(F.when(F.col("grp") == b, F.col("share"))).alias("share_b"))
    return g.withColumn("difference", F.col("share_b") - F.col("share_a"))


def coefficient_table(fits: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Estimates with intervals, odds ratios and stars."""
    lo, hi = F.col("estimate") - z * F.col("std_error"), F.col("estimate") + z * F.col("std_error")
    stars = F.when(F.col("pvalue") < 0.001, "***").when(F.col("pvalue") < 0.01, "**").when(F.col("pvalue") < 0.05, "*").otherwise("")
    return fits.select("feature_id", "term", "estimate", lo.alias("low"), hi.alias("high"), F.exp("estimate").alias("odds_ratio"), F.exp(lo).alias("or_low"), F.exp(hi).alias("or_high"), stars.alias("stars"))


def correlate_tables(a: DataFrame, b: DataFrame, least: int = 3) -> DataFrame:
    """Correlation of every variable of `a` with every one of `b` (both: variable, item, value), with its t and df."""
    j = a.select(F.col("variable").alias("x"), "item", F.col("value").alias("u")).join(b.select(F.col("variable").alias("y"), "item", F.col("value").alias("v")), "item")
    g = j.where("u IS NOT NULL AND v IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.corr("u", "v").alias("r")).where(F.col("n") >= least)
    return g.withColumns({"t": F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col("r") * F.col("r"))), "df": F.col("n") - 2})


def hub_genes(membership: DataFrame, significance: DataFrame, least_member: float, least_signif: float, n: int) -> DataFrame:
    """Genes of a module (module, gene, r) that pass both bounds, best n per module by significance."""
    x = membership.where(F.abs("r") >= least_member).join(significance.select("gene", F.col("r").alias("gs")), "gene").where(F.abs("gs") >= least_signif)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(F.abs("gs").desc(), "gene"))).where(F.col("rank") <= n)


def compare_importance(a: DataFrame, b: DataFrame, low: float = 0.25) -> DataFrame:
    """Two importances (variable, value) by full outer join, absent 0: average-tie rank shares and whether both are low."""
    x = a.select("variable", F.col("value").alias("va")).join(b.select("variable", F.col("value").alias("vb")), "variable", "full").na.fill(0.0, ["va", "vb"])
    everything = Window.partitionBy()
    share = lambda c: (F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0) / F.count(F.lit(1)).over(everything)
    x = x.withColumns({"rank_a": share("va"), "rank_b": share("vb")})
    return x.withColumns({"mean_rank": (F.col("rank_a") + F.col("rank_b")) / 2, "low": (F.col("rank_a") <= low) & (F.col("rank_b") <= low)})


def projection_confidence(neighbours: DataFrame, training: DataFrame) -> DataFrame:
    """Per projected item from its training neighbours (id, other) and (id, cluster, margin): modal cluster (ties to the
    smaller), its share, mean and least margin."""
    j = neighbours.join(training.select(F.col("id").alias("other"), "cluster", "margin"), "other")
    per = j.groupBy("id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("margin").alias("s"), F.min("margin").alias("m"))
    w = Window.partitionBy("id")
    per = per.withColumns({"all": F.sum("n").over(w), "total": F.sum("s").over(w), "least": F.min("m").over(w), "k": F.row_number().over(w.orderBy(F.col("n").desc(), "cluster"))})
    return per.where("k = 1").select("id", "cluster", (F.col("n") / F.col("all")).alias("purity"), (F.col("total") / F.col("all")).alias("mean_margin"), F.col("least").alias("least_margin"))


def top_activities(scores: DataFrame, by: str, n: int) -> DataFrame:
    """Sources with the largest variance, mean absolute or maximal absolute score."""
    m = {"variance": F.var_samp("score"), "mean_abs": F.avg(F.abs("score")), "max_abs": F.max(F.abs("score"))}[by]
    return scores.groupBy("source").agg(m.alias("strength")).orderBy(F.col("strength").desc_nulls_last(), "source").limit(n)


def consensus_scores(methods: DataFrame) -> DataFrame:
    """(method, source, sample_id, score): z-score within each method over the pairs that all methods have, then the mean."""
    n = methods.agg(F.countDistinct("method").alias("__n"))
    ok = methods.groupBy("source", "sample_id").agg(F.countDistinct("method").alias("__k")).crossJoin(F.broadcast(n)).where("__k = __n").select("source", "sample_id")
    x = methods.join(ok, ["source", "sample_id"], "left_semi")
    w = Window.partitionBy("method")
    z = F.try_divide(F.col("score") - F.avg("score").over(w), F.stddev_samp("score").over(w))
    return x.withColumn("z", z).groupBy("source", "sample_id").agg(F.avg("z").alias("consensus"), F.count(F.lit(1)).alias("n_methods"))


def rank_pairs(pairwise: DataFrame, a: str, b: str) -> DataFrame:
    return pairwise.where((F.col("cluster_a") == a) & (F.col("cluster_b") == b)).select("gene", (F.col("auc") - 0.5).alias("stat")).where("stat IS NOT NULL")


def orthologs(df: DataFrame, mapping: DataFrame, drop: bool = True) -> DataFrame:
    x = df.join(first_match(mapping.select("gene", "ortholog"), "gene", [F.col("ortholog")]), "gene", "left")
    return x.where("ortholog IS NOT NULL") if drop else x


def summarise_results(results: DataFrame, p_cut: float = 0.05) -> DataFrame:
    sig = F.col("padj") < p_cut
    return results.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_tested"), F.count_if(sig).alias("n_sig"), F.count_if(sig & (F.col("log2FoldChange") > 0)).alias("n_up"), F.count_if(sig & (F.col("log2FoldChange") < 0)).alias("n_down"))
