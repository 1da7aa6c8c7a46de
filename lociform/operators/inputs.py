"""Tables from upstream runs brought to common shape: spliced counts, transposable elements, spike-ins, merged cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def splice_counts(runs: list[DataFrame]) -> DataFrame:
    """Transcript assignments (bc_wells, gene_name, exonic) of several runs to spliced and unspliced counts; a cell's name gets its
    run's number, <cell>__s<k>, and quotes around gene names go."""
    out = None
    for k, run in enumerate(runs, 1):
        gene = F.regexp_replace("gene_name", '^"+|"+$', "")
        x = run.groupBy(F.concat("bc_wells", F.lit(f"__s{k}")).alias("cell"), gene.alias("gene")).agg(F.count_if(F.col("exonic")).alias("spliced"), F.count_if(~F.col("exonic")).alias("unspliced"))
        out = x if out is None else out.unionByName(x)
    return out


def keep_described(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Counts of the cells and genes that have metadata, with those of the cell (by bc_wells) and of the gene (by gene_name; the
    smallest row where a name has several)."""
    rest = [c for c in genes.columns if c != "gene_name"]
    one = genes.withColumn("gene", F.regexp_replace("gene_name", '^"+|"+$', "")).withColumn("__k", F.row_number().over(Window.partitionBy("gene").orderBy(*rest))).where("__k = 1").select("gene", *rest)
    x = counts.join(cells.withColumnRenamed("bc_wells", "cell"), "cell").join(one, "gene")
    return x


def velocity_ready(splicing: DataFrame) -> DataFrame:
    """(check, level, ok, value) of a table (cell, gene, spliced, unspliced): what rules velocity out (hard) and what is doubtful (soft)."""
    whole = (F.col("spliced") == F.floor("spliced")) & (F.col("unspliced") == F.floor("unspliced"))
    a = splicing.agg(
        F.sum("spliced").cast("double").alias("s"), F.sum("unspliced").cast("double").alias("u"), F.count_if(F.col("spliced").isNull() | F.col("unspliced").isNull()).alias("nulls"),
        F.count_if(~whole).alias("broken"), F.count_if((F.col("spliced") < 0) | (F.col("unspliced") < 0)).alias("negative"), F.countDistinct("cell").alias("cells"), F.countDistinct("gene").alias("genes"),
    )
    share = F.try_divide(F.col("u"), F.col("s") + F.col("u"))
    rows = [
        ("complete", "hard", F.col("nulls") == 0, F.col("nulls")), ("whole_counts", "hard", F.col("broken") == 0, F.col("broken")), ("not_negative", "hard", F.col("negative") == 0, F.col("negative")),
        ("has_spliced", "hard", F.col("s") > 0, F.col("s")), ("has_unspliced", "hard", F.col("u") > 0, F.col("u")), ("unspliced_share", "soft", share.between(0.05, 0.6), share),
        ("cells", "soft", F.col("cells") >= 50, F.col("cells")), ("genes", "soft", F.col("genes") >= 100, F.col("genes")),
    ]
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(lv).alias("level"), F.coalesce(ok, F.lit(False)).alias("ok"), v.cast("double").alias("value")) for n, lv, ok, v in rows])).alias("r")
    return a.select(made).select("r.*")


def fragment_sizes(alignments: DataFrame, most: int = 1000) -> DataFrame:
    """Pairs by insert size, from the first mates' template lengths."""
    return alignments.where((F.col("tlen") != 0) & (F.abs("tlen") <= most)).groupBy(F.abs("tlen").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def split_spike_in(reads: DataFrame, prefix: str = "spikein_") -> tuple[DataFrame, DataFrame]:
    """(host, spike-in) reads by the prefix of the chromosome's name. It is an error if either side has none."""
    own = F.startswith(F.col("chr"), F.lit(prefix))
    host, spike = reads.where(~own), reads.where(own)
    for name, side in (("host", host), ("spike-in", spike)):
        if side.isEmpty():
            raise ValueError(f"no {name} reads (prefix {prefix!r})")
    return host, spike


def element_ids(gtf: DataFrame) -> DataFrame:
    """Distinct gene:family:class ids of an annotation of transposable elements."""
    return gtf.select(F.concat_ws(":", "gene_id", "family_id", "class_id").alias("feature_id")).distinct()


def element_counts(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """The counts of elements among (feature_id, sample_id, value)."""
    return counts.join(ids, "feature_id", "left_semi")


def merge_counts(genes: DataFrame, elements: DataFrame) -> DataFrame:
    """Gene and element counts of the samples that both have. Equal feature ids on both sides, and no common sample, are errors."""
    both = genes.select("feature_id").distinct().intersect(elements.select("feature_id").distinct())
    if rows := both.limit(10).collect():
        raise ValueError(f"features on both sides: {sorted(r.feature_id for r in rows)}")
    common = genes.select("sample_id").distinct().intersect(elements.select("sample_id").distinct())
    if common.isEmpty():
        raise ValueError("no sample in common")
    return genes.unionByName(elements).join(common, "sample_id", "left_semi").select("feature_id", "sample_id", "value")


def merge_cells(tables: dict[str, DataFrame], column: str = "sample_id") -> DataFrame:
    """Cell tables (cell, gene, ...) under each other with their names as `column`. All must have the same genes."""
    first = None
    for name, t in tables.items():
        genes = t.select("gene").distinct()
        if first is None:
            first = genes
        elif not genes.exceptAll(first).isEmpty() or not first.exceptAll(genes).isEmpty():
            raise ValueError(f"{name} has other genes than the first table")
    out = None
    for name, t in tables.items():
        x = t.withColumn(column, F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


def validate_frames(frames: dict[str, DataFrame], required: dict[str, list[str]]) -> list[str]:
    """What is missing: tables that are absent or empty and columns that they lack; nothing if all is there."""
    out = []
    for name, columns in required.items():
        t = frames.get(name)
        if t is None:
            out.append(f"no table {name}")
            continue
        out += [f"{name} lacks {c}" for c in columns if c not in t.columns]
        if t.isEmpty():
            out.append(f"{name} is empty")
    return out


def validate_views(views: DataFrame) -> DataFrame:
    """(view, n_samples, n_features, n_missing, ok) of (view, sample, feature, value): views with a feature and as many samples as the
    largest, and no missing value, are fit for joint models."""
    g = views.groupBy("view").agg(F.countDistinct("sample").alias("n_samples"), F.countDistinct("feature").alias("n_features"), F.count_if(F.col("value").isNull()).alias("n_missing"))
    most = F.max("n_samples").over(Window.partitionBy())  # a row per view
    return g.withColumn("ok", (F.col("n_samples") == most) & (F.col("n_features") > 0) & (F.col("n_missing") == 0))


def chromosome_names() -> dict[str, str]:
    """Plain to prefixed names of the chromosomes of human-like assemblies."""
    return {**{n: f"chr{n}" for n in [*map(str, range(1, 23)), "X", "Y"]}, "MT": "chrM"}


def good_samples_genes(values: DataFrame, least: float = 0.5) -> DataFrame:
    """Values of features that vary and of which, as of the samples among them, at least the share `least` is present."""
    n = values.agg(F.countDistinct("sample_id").alias("n"))
    g = values.groupBy("feature_id").agg(F.count("value").alias("k"), F.var_samp("value").alias("v")).crossJoin(F.broadcast(n))
    good = g.where((F.col("k") >= least * F.col("n")) & (F.col("v") > 0)).select("feature_id")
    x = values.join(good, "feature_id", "left_semi")
    m = good.agg(F.count(F.lit(1)).alias("m"))
    s = x.groupBy("sample_id").agg(F.count("value").alias("k")).crossJoin(F.broadcast(m)).where(F.col("k") >= least * F.col("m")).select("sample_id")
    return x.join(s, "sample_id", "left_semi").select("feature_id", "sample_id", "value")
