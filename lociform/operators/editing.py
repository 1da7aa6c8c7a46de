"""RNA-editing operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import complement

BASES = "ACGT"


def base_counts(reads: DataFrame) -> DataFrame:
    """(region, position, reference, base) per read to counts per site, coverage, substitution codes and frequency."""
    n = [F.count_if(F.col("base") == b).alias(f"count_{b}") for b in BASES]
    g = reads.where(F.col("base").isin(*BASES)).groupBy("region", "position", "reference").agg(*n)
    cover = sum((F.col(f"count_{b}") for b in BASES), F.lit(0).cast("bigint"))
    codes = F.array_compact(F.array(*[F.when((F.col("reference") != b) & (F.col(f"count_{b}") > 0), F.concat("reference", F.lit(b))) for b in BASES]))
    own = F.coalesce(*[F.when(F.col("reference") == b, F.col(f"count_{b}")) for b in BASES], F.lit(0))
    return g.withColumns({"coverage": cover, "all_subs": F.when(F.size(codes) == 0, "-").otherwise(F.array_join(codes, " ")), "frequency": F.try_divide(cover - own, cover)})


def parse_counts(text: DataFrame, column: str = "BaseCount[A,C,G,T]") -> DataFrame:
    """'[0, 5, 100, 3]' to four count columns."""
    parts = F.split(F.regexp_replace(F.col(f"`{column}`"), r"[\[\]\s]", ""), ",")
    return text.withColumns({f"count_{b}": F.get(parts, k).try_cast("bigint") for k, b in enumerate(BASES)})


def primary_alt(sites: DataFrame) -> DataFrame:
    """The base with most reads among the substitution codes of all_subs whose first letter is the reference (the first code on
    ties), its count and share; NULL where no code is."""
    counts = F.create_map(*[x for b in BASES for x in (F.lit(b), F.col(f"count_{b}").cast("bigint"))])
    codes = F.filter(F.split("all_subs", r"\s+"), lambda c: (F.length(c) == 2) & (F.substring(c, 1, 1) == F.col("reference")))
    best = F.array_max(F.transform(codes, lambda c, k: F.struct(F.element_at(counts, F.substring(c, 2, 1)).alias("n"), (-k).alias("k"), F.substring(c, 2, 1).alias("b"))))
    x = sites.withColumn("__a", best)
    return x.withColumns({"alt": F.col("__a.b"), "alt_count": F.col("__a.n"), "alt_share": F.try_divide(F.col("__a.n"), F.col("coverage"))}).drop("__a")


def germline(editing: DataFrame, dna: DataFrame, candidate: Column | None = None, min_coverage: int = 10, min_reads: int = 3, min_share: float = 0.1) -> DataFrame:
    """All editing sites; the candidates among them that have a primary alternative get dna_coverage, dna_alt_reads, dna_alt_freq
    and germline_status: undetermined (no or too little DNA), germline (the edited base is in the DNA by both bounds) or
    confirmed_somatic. The rest keep NULLs."""
    ok = F.col("alt").isNotNull() if candidate is None else F.coalesce(candidate, F.lit(False)) & F.col("alt").isNotNull()
    d = dna.select("region", "position", F.col("coverage").alias("__cover"), *[F.col(f"count_{b}").alias(f"__dna_{b}") for b in BASES])
    x = editing.join(d, ["region", "position"], "left").withColumn("__ok", ok)
    n = F.coalesce(*[F.when(F.col("alt") == b, F.col(f"__dna_{b}")) for b in BASES])
    only = lambda c: F.when(F.col("__ok"), c)
    x = x.withColumns({"dna_coverage": only(F.col("__cover")), "dna_alt_reads": only(n)})
    x = x.withColumn("dna_alt_freq", F.when(F.col("dna_coverage") > 0, F.col("dna_alt_reads") / F.col("dna_coverage")))
    status = F.when(F.coalesce("dna_coverage", F.lit(0)) < min_coverage, "undetermined").when(F.coalesce((F.col("dna_alt_reads") >= min_reads) & (F.col("dna_alt_freq") >= min_share), F.lit(False)), "germline").otherwise("confirmed_somatic")
    return x.withColumn("germline_status", only(status)).drop("__cover", "__ok", *[f"__dna_{b}" for b in BASES])


def motif_rates(catalog: DataFrame, editing: DataFrame, code: str = "CT", min_coverage: int = 1) -> DataFrame:
    """Editing at catalogued sites (region, position, gtf_strand, grp): per sample and group the sites seen, edited, and
    their mean and pooled rates. A minus-strand site is read as its complement."""
    ref, alt = F.lit(code[0]), F.lit(code[1])
    j = editing.join(catalog, ["region", "position"])
    minus = F.col("gtf_strand") == "-"
    want, edit = F.when(minus, complement(ref)).otherwise(ref), F.when(minus, complement(alt)).otherwise(alt)
    n = F.coalesce(*[F.when(edit == b, F.col(f"count_{b}")) for b in BASES], F.lit(0))
    j = j.where((F.col("reference") == want) & (F.col("coverage") >= min_coverage)).withColumn("n", n)
    return j.groupBy("sample_id", "grp").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("n") > 0).alias("n_edited"), F.avg(F.col("n") / F.col("coverage")).alias("mean_rate"), (F.sum("n") / F.sum("coverage")).alias("pooled_rate"))


def motif_enrichment(rates: DataFrame) -> DataFrame:
    """Target over control pooled rate per sample."""
    pick = lambda g: F.max(F.when(F.col("grp") == g, F.col("pooled_rate")))
    return rates.groupBy("sample_id").agg(pick("target").alias("target_rate"), pick("control").alias("control_rate")).withColumn("ratio", F.try_divide("target_rate", "control_rate"))


def read_filter(alignments: DataFrame, min_mapq: int = 20, min_length: int = 1, paired: bool = True) -> DataFrame:
    """Mapped, primary, not duplicate or failed reads of enough quality and length, without a supplementary alignment,
    and for pairs one of the four proper flags."""
    has = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    ok = ~has(4) & ~has(256) & ~has(512) & ~has(1024) & ~has(2048) & (F.col("mapq") >= min_mapq) & (F.length("seq") >= min_length) & ~F.coalesce("has_sa", F.lit(False))
    return alignments.where(ok & F.col("flag").isin(99, 147, 83, 163) if paired else ok)


def mark_duplicates(alignments: DataFrame) -> DataFrame:
    """`duplicate`: another template has the same ends (place and strand of both mates) and a better summed base quality (or a
    smaller name). Both mates of a template are marked alike. A read without quality counts 0."""
    quality = F.aggregate(F.filter(F.split("qual", ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c) - 33)
    end = F.struct("chr", "pos", F.col("flag").bitwiseAND(F.lit(16)).alias("strand"))
    t = alignments.groupBy("qname").agg(F.sort_array(F.collect_list(end)).alias("ends"), F.sum(F.coalesce(quality, F.lit(0))).alias("__q"))
    w = Window.partitionBy("ends").orderBy(F.col("__q").desc(), "qname")
    t = t.select("qname", (F.row_number().over(w) > 1).alias("duplicate"))
    return alignments.join(t, "qname")


def substitution_spectrum(sites: DataFrame) -> DataFrame:
    x = sites.where("all_subs <> '-'").select("sample_id", F.explode(F.split("all_subs", " ")).alias("code"))
    g = x.groupBy("sample_id", "code").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample_id")))


def downsample(reads: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Keep read names whose hash falls below the fraction, so mates stay together."""
    return reads.where(F.pmod(F.xxhash64("qname", F.lit(seed)), F.lit(1 << 30)) < int(fraction * (1 << 30)))
