"""Bases of aligned reads per position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .editing import BASES, read_filter


def aligned_bases(alignments: DataFrame) -> DataFrame:
    """(qname, chr, position, base, quality) of every base that its read's CIGAR aligns to the reference.

    `pos` is the 0-based start of the alignment, `position` 1-based. Insertions and clips move along the read only, deletions and skips along the
    reference only. A read without a CIGAR aligns nothing.
    """
    sizes = "transform(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1), x -> cast(x AS int))"
    kinds = "regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1)"
    empty = "cast(array() AS array<struct<r:int,q:int,n:int>>)"
    step = (
        "named_struct('r', s.r + IF(o.k IN ('M', 'D', 'N', '=', 'X'), o.n, 0), 'q', s.q + IF(o.k IN ('M', 'I', 'S', '=', 'X'), o.n, 0), "
        f"'blocks', IF(o.k IN ('M', '=', 'X'), concat(s.blocks, array(named_struct('r', s.r, 'q', s.q, 'n', o.n))), s.blocks))"
    )
    walk = F.expr(f"aggregate(zip_with({sizes}, {kinds}, (n, k) -> named_struct('n', n, 'k', k)), named_struct('r', 0, 'q', 0, 'blocks', {empty}), (s, o) -> {step}).blocks")
    x = alignments.where("cigar RLIKE '^([0-9]+[MIDNSHP=X])+$'").select("qname", "chr", "pos", "seq", "qual", F.explode(walk).alias("b")).where("b.n > 0")
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("b.n") - 1)).alias("i"))
    at = F.col("b.q") + F.col("i") + 1
    return x.select(
        "qname", "chr", (F.col("pos") + F.col("b.r") + F.col("i") + 1).alias("position"), F.upper(F.substring("seq", at, F.lit(1))).alias("base"),
        (F.ascii(F.substring("qual", at, F.lit(1))) - 33).alias("quality"),
    )


def targeted_pileup(alignments: DataFrame, sites: DataFrame, min_base_quality: int = 30, min_read_quality: int = 20, min_read_length: int = 30) -> DataFrame:
    """One row per site (chr, position, reference): coverage and count_A, C, G, T of the bases of enough quality in reads that pass
    read_filter(). Sites that no read covers stay, with zeros; coverage counts the four bases only."""
    b = aligned_bases(read_filter(alignments, min_read_quality, min_read_length)).where((F.col("quality") >= min_base_quality) & F.col("base").isin(*BASES))
    wanted = sites.select("chr", "position").distinct()
    n = b.join(wanted, ["chr", "position"], "left_semi").groupBy("chr", "position").agg(*[F.count_if(F.col("base") == x).alias(f"count_{x}") for x in BASES])
    out = sites.join(n, ["chr", "position"], "left").na.fill(0, [f"count_{x}" for x in BASES])
    return out.withColumn("coverage", sum((F.col(f"count_{x}") for x in BASES), F.lit(0).cast("bigint")))
