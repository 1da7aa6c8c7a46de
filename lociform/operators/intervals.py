"""Interval operators over (chr, start, stop), 0-based and half-open.

Nothing is partitioned by chromosome alone: rows go to bins of it, running values are computed inside a bin, and what a
bin inherits from the bins before it comes from one small row per bin. So one huge chromosome is spread over as many
tasks as it has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 17


def _bin(df: DataFrame, at: str, width: int) -> DataFrame:
    return df.withColumn("__bin", F.floor(F.col(at) / width))


def _before(small: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Per bin, `value` (an aggregate column) over all earlier bins of the keys."""
    w = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    return small.select(*keys, "__bin", value.over(w).alias(name))


def island_ids(df: DataFrame, distance: int = 0, keys: list[str] | None = None, width: int = BIN) -> DataFrame:
    """`df` with `island`, numbered along each chromosome: an interval joins the island before it if it starts no
    further than `distance` behind the furthest stop so far (touching counts)."""
    keys = keys or ["chr"]
    b = _bin(df, "start", width)
    inside = Window.partitionBy(*keys, "__bin").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    ends = b.groupBy(*keys, "__bin").agg(F.max("stop").alias("__top"))
    carry = _before(ends, keys, F.max("__top"), "__carry")
    x = b.join(carry, [*keys, "__bin"])
    furthest = F.greatest(F.max("stop").over(inside), F.col("__carry"))
    x = x.withColumn("__new", F.when(furthest.isNull() | (F.col("start") > furthest + distance), 1).otherwise(0))
    opened = x.groupBy(*keys, "__bin").agg(F.sum("__new").alias("__n"))
    base = _before(opened, keys, F.sum("__n"), "__base")
    # equal intervals are peers of one frame, so their order does not matter
    upto = Window.partitionBy(*keys, "__bin").orderBy("start", "stop").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.join(base, [*keys, "__bin"])
    x = x.withColumn("island", (F.coalesce("__base", F.lit(0)) + F.sum("__new").over(upto)).cast("bigint"))
    return x.drop("__bin", "__carry", "__new", "__base")


def merge(df: DataFrame, distance: int = 0, aggs: list[Column] | None = None, keys: list[str] | None = None, width: int = BIN) -> DataFrame:
    """One row per island: keys, start, stop and `aggs` over its intervals."""
    keys = keys or ["chr"]
    g = island_ids(df, distance, keys, width).groupBy(*keys, "island")
    return g.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *(aggs or [])).drop("island")


def consensus(fragments: DataFrame, min_samples: int = 2, distance: int = 0) -> DataFrame:
    """Merged regions that at least `min_samples` samples support."""
    m = merge(fragments, distance, [F.count(F.lit(1)).alias("n_fragments"), F.countDistinct("sample_id").alias("n_samples")])
    return m.where(F.col("n_samples") >= min_samples).withColumn("width", F.col("stop") - F.col("start"))


def expand(df: DataFrame, upstream: int, downstream: int, sizes: DataFrame | None = None, stranded: bool = False) -> DataFrame:
    """Widen intervals, clamped to 0 and, given (chr, size), to the chromosome; stranded swaps the sides on minus."""
    left, right = F.lit(upstream), F.lit(downstream)
    if stranded:
        minus = F.col("strand") == "-"
        left, right = F.when(minus, downstream).otherwise(upstream), F.when(minus, upstream).otherwise(downstream)
    out = df.withColumns({"start": F.greatest(F.lit(0), F.col("start") - left), "stop": F.col("stop") + right})
    if sizes is None:
        return out
    out = out.join(sizes.select("chr", F.col("size").alias("__size")), "chr", "left")
    return out.withColumn("stop", F.least("stop", F.coalesce("__size", F.col("stop")))).drop("__size").where("start < stop")


def center(df: DataFrame, half: int) -> DataFrame:
    mid = F.floor((F.col("start") + F.col("stop")) / 2)
    return df.withColumns({"start": F.greatest(F.lit(0), mid - half), "stop": mid + half})


def overlap_pairs(a: DataFrame, b: DataFrame, closed: bool = False, min_overlap: int = 0, stranded: bool = False, width: int = 1 << 12) -> DataFrame:
    """All columns of `a` and, prefixed b_, of `b` for each overlapping pair, with overlap_bp.

    Each interval is filed under every bin it touches; a pair meets in all common bins and is kept in the first.
    closed=True also pairs intervals that only touch.
    """
    edge = 0 if closed else 1
    span = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - edge, F.col(s))) / width))).alias("__bin")
    x = a.select("*", span("start", "stop"))
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).select("*", span("b_start", "b_stop"))
    on = (x.chr == y.b_chr) & (x["__bin"] == y["__bin"])
    meet = (x.start <= y.b_stop) & (y.b_start <= x.stop) if closed else (x.start < y.b_stop) & (y.b_start < x.stop)
    first = x["__bin"] == F.greatest(F.floor(x.start / width), F.floor(y.b_start / width))
    cond = on & meet & first
    if stranded:
        cond = cond & (x.strand == y.b_strand)
    out = x.join(y, cond).drop("__bin")
    out = out.withColumn("overlap_bp", F.least("stop", "b_stop") - F.greatest("start", "b_start"))
    return out.where(F.col("overlap_bp") >= min_overlap) if min_overlap else out


def count_overlaps(regions: DataFrame, fragments: DataFrame, key: str, by: list[str], **how) -> DataFrame:
    """Fragments per region and `by` (columns of the fragments): key, by..., value."""
    p = overlap_pairs(fragments, regions, **how)
    return p.groupBy(F.col(f"b_{key}").alias(key), *by).agg(F.count(F.lit(1)).alias("value"))


def anti(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `a` that overlap nothing in `b`."""
    return a.join(overlap_pairs(a, b).select(*key).distinct(), key, "left_anti")


def semi(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(overlap_pairs(a, b).select(*key).distinct(), key, "left_semi")


def nearest(queries: DataFrame, subjects: DataFrame, subject_id: str, width: int = BIN) -> DataFrame:
    """`queries` with nearest_id and distance in bases (0 on overlap and on adjacency), NULL on an unmatched
    chromosome; ties go to the side before, then to the smaller id. Two running as-of values over the sorted union."""
    q = queries.select("*", F.lit(1).alias("__q"), F.col("start").alias("__at"))
    s = subjects.select("chr", F.col("start").alias("__at"), F.lit(0).alias("__q"), F.struct(F.col("stop").alias("e"), (-F.col(subject_id)).alias("i")).alias("__left"), F.struct(F.col("start").alias("s"), F.col(subject_id).alias("i")).alias("__right"))
    u = _bin(q.unionByName(s, allowMissingColumns=True), "__at", width)
    keys = ["chr"]
    small = u.groupBy("chr", "__bin").agg(F.max("__left").alias("__l"), F.min("__right").alias("__r"))
    back = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.col("__bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    small = small.select("chr", "__bin", F.max("__l").over(back).alias("__lc"), F.min("__r").over(ahead).alias("__rc"))
    x = u.join(small, ["chr", "__bin"])
    order = Window.partitionBy("chr", "__bin").orderBy("__at", "__q")
    left = F.max("__left").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the mirrored order, since a frame that only grows is aggregated once
    mirrored = Window.partitionBy("chr", "__bin").orderBy(F.col("__at").desc(), F.col("__q").desc())
    right = F.min("__right").over(mirrored.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumns({"__l2": F.greatest(left, F.col("__lc")), "__r2": F.least(right, F.col("__rc"))}).where("__q = 1")
    dl = F.greatest(F.lit(0), F.col("start") - F.col("__l2.e"))
    dr = F.greatest(F.lit(0), F.col("__r2.s") - F.col("stop"))
    dl, dr = F.when(F.col("__l2").isNotNull(), dl), F.when(F.col("__r2").isNotNull(), dr)
    takes_left = dr.isNull() | (dl <= dr)
    out = x.withColumns({"nearest_id": F.when(takes_left & dl.isNotNull(), -F.col("__l2.i")).otherwise(F.col("__r2.i")), "distance": F.least(dl, dr)})
    return out.select(*queries.columns, "nearest_id", "distance")


def within(genes: DataFrame, peaks: DataFrame, distance: int) -> DataFrame:
    """Pairs of genes (gene_id, chr, 1-based tss, strand, further columns) and peaks (peak_id, chr, start, stop) that touch the
    window of `distance` around the TSS, with distance_to_tss: from the TSS to the peak's middle, rounded half to even,
    negative upstream of the gene."""
    rest = [c for c in genes.columns if c not in ("gene_id", "chr", "tss", "strand")]
    g = genes.withColumns({"start": F.greatest(F.lit(0), F.col("tss") - distance - 1), "stop": F.col("tss") + distance})
    p = overlap_pairs(g, peaks.select("peak_id", "chr", "start", "stop"))
    away = (F.col("b_start") + 1 + F.col("b_stop")) / 2 - F.col("tss")
    signed = F.bround(F.when(F.col("strand") == "-", -away).otherwise(away), 0).cast("bigint")
    return p.select("gene_id", F.col("b_peak_id").alias("peak_id"), "chr", signed.alias("distance_to_tss"), F.abs(signed).alias("abs_distance"), *rest)


def gene_links(genes: DataFrame, links: DataFrame) -> DataFrame:
    """All genes with has_peak, n_peaks and nearest_peak_distance (NULL without a peak)."""
    g = links.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_peaks"), F.min("abs_distance").alias("nearest_peak_distance"))
    x = genes.join(g, "gene_id", "left")
    return x.withColumns({"has_peak": F.col("n_peaks").isNotNull(), "n_peaks": F.coalesce("n_peaks", F.lit(0))})


def peak_links(peaks: DataFrame, links: DataFrame) -> DataFrame:
    """All peaks with near_gene, n_genes, nearest_gene (ties to the smaller id) and nearest_gene_distance."""
    g = links.groupBy("peak_id").agg(F.count(F.lit(1)).alias("n_genes"), F.min(F.struct("abs_distance", "gene_id")).alias("__b"))
    x = peaks.join(g, "peak_id", "left")
    return x.withColumns({"near_gene": F.col("n_genes").isNotNull(), "n_genes": F.coalesce("n_genes", F.lit(0)), "nearest_gene": F.col("__b.gene_id"), "nearest_gene_distance": F.col("__b.abs_distance")}).drop("__b")


def coverage(df: DataFrame, keys: list[str] | None = None, width: int = BIN) -> DataFrame:
    """Depth as a step function (keys, start, stop, depth), depth > 0 only: summed +1/-1 events, running inside bins."""
    keys = keys or ["chr"]
    ev = df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    ev = _bin(ev.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0"), "at", width)
    base = _before(ev.groupBy(*keys, "__bin").agg(F.sum("d").alias("n")), keys, F.sum("n"), "__base")
    firsts = ev.groupBy(*keys, "__bin").agg(F.min("at").alias("first"))
    w2 = Window.partitionBy(*keys).orderBy("__bin")
    firsts = firsts.withColumn("__next", F.lead("first").over(w2)).drop("first")
    w = Window.partitionBy(*keys, "__bin").orderBy("at")
    x = ev.join(base, [*keys, "__bin"]).join(firsts, [*keys, "__bin"])
    x = x.select(*keys, F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.col("__next")).alias("stop"), (F.coalesce("__base", F.lit(0)) + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("depth"))
    return x.where("depth > 0 AND stop IS NOT NULL")


def coverage_blocks(steps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stretches of adjoining depth: keys, start, stop, total_signal (area) and max_signal."""
    return merge(steps, 0, [F.sum((F.col("stop") - F.col("start")) * F.col("depth")).alias("total_signal"), F.max("depth").alias("max_signal")], keys)


def bin_average(steps: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """Width-weighted mean depth of fixed bins that have any: keys, start, stop, score."""
    keys = keys or ["chr"]
    x = steps.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("k"))
    lo, hi = F.col("k") * size, (F.col("k") + 1) * size
    part = (F.least(F.col("stop"), hi) - F.greatest(F.col("start"), lo)) * F.col("depth")
    g = x.groupBy(*keys, "k").agg((F.sum(part) / F.lit(float(size))).alias("score"))
    return g.select(*keys, (F.col("k") * size).alias("start"), ((F.col("k") + 1) * size).alias("stop"), "score")


def bin_counts(df: DataFrame, size: int, cap_sds: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Intervals per fixed bin that they touch; optionally capped at mean + cap_sds standard deviations."""
    keys = keys or ["chr"]
    x = df.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("k"))
    g = x.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"))
    g = g.select(*keys, (F.col("k") * size).alias("start"), ((F.col("k") + 1) * size).alias("stop"), "n")
    if cap_sds is None:
        return g
    cap = g.agg((F.avg("n") + cap_sds * F.stddev_samp("n")).alias("cap"))
    return g.crossJoin(F.broadcast(cap)).withColumn("capped", F.least(F.col("n").cast("double"), "cap")).drop("cap")


def set_algebra(a: DataFrame, b: DataFrame, kind: str, width: int = BIN) -> DataFrame:
    """Positions in both (intersect), in a only (subtract) or in either (union) as maximal stretches, by one event sweep.

    The events are shuffled once, by chromosome and bin. A bin takes the depths at its start from one small row per bin, so it
    knows at each of its events whether the wanted state begins or ends there; begins and ends then alternate.
    """
    one = lambda df, x, y: df.select("chr", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(x).alias("x"), F.lit(y).alias("y")), F.struct(F.col("stop").alias("at"), F.lit(-x).alias("x"), F.lit(-y).alias("y")))).alias("e")).select("chr", "e.at", "e.x", "e.y")
    ev = _bin(one(a.where("start < stop"), 1, 0).unionAll(one(b.where("start < stop"), 0, 1)), "at", width).repartition("chr", "__bin")
    ev = ev.groupBy("chr", "__bin", "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    small = ev.groupBy("chr", "__bin").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    pre = Window.partitionBy("chr").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    small = small.select("chr", "__bin", F.coalesce(F.sum("x").over(pre), F.lit(0)).alias("bx"), F.coalesce(F.sum("y").over(pre), F.lit(0)).alias("by"))
    run = Window.partitionBy("chr", "__bin").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = {"intersect": lambda x, y: (x > 0) & (y > 0), "subtract": lambda x, y: (x > 0) & (y == 0), "union": lambda x, y: (x > 0) | (y > 0)}[kind]
    s = ev.join(small, ["chr", "__bin"]).withColumns({"in_a": F.col("bx") + F.sum("x").over(run), "in_b": F.col("by") + F.sum("y").over(run)})
    s = s.withColumns({"on": wanted(F.col("in_a"), F.col("in_b")), "was": wanted(F.col("in_a") - F.col("x"), F.col("in_b") - F.col("y"))}).where("on <> was").select("chr", "__bin", "at", "on")
    first = s.groupBy("chr", "__bin").agg(F.min("at").alias("first"))
    first = first.select("chr", "__bin", F.lead("first").over(Window.partitionBy("chr").orderBy("__bin")).alias("next"))
    after = F.coalesce(F.lead("at").over(Window.partitionBy("chr", "__bin").orderBy("at")), F.col("next"))
    return s.join(first, ["chr", "__bin"]).select("chr", F.col("at").alias("start"), after.alias("stop"), "on").where("on").select("chr", "start", "stop")


def profile(points: DataFrame, fragments: DataFrame, flank: int, bin_size: int) -> DataFrame:
    """Fragment starts around points (chr, pos, strand) by signed bin: bin, n."""
    w = points.select("chr", F.greatest(F.lit(0), F.col("pos") - flank).alias("start"), (F.col("pos") + flank + 1).alias("stop"), "pos", "strand")
    cuts = fragments.select("chr", "start", (F.col("start") + 1).alias("stop"))
    p = overlap_pairs(cuts, w)
    away = F.when(F.col("b_strand") == "-", F.col("b_pos") - F.col("start")).otherwise(F.col("start") - F.col("b_pos"))
    return p.groupBy(F.floor(away / bin_size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def annotate_priority(peaks: DataFrame, features: DataFrame, order: list[str], default: str = "intergenic") -> DataFrame:
    """Peaks with the first feature type of `order` that they overlap, else `default`."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("b_kind")), F.lit(0))
    best = overlap_pairs(peaks, features.where(F.col("kind").isin(order))).groupBy("peak_id").agg(F.min(rank).alias("__r"))
    out = peaks.join(best, "peak_id", "left")
    return out.withColumn("annotation", F.coalesce(F.get(F.array(*map(F.lit, order)), F.col("__r").cast("int") - 1), F.lit(default))).drop("__r")


def shift_fragments(pairs: DataFrame, plus: int = 4, minus: int = 5) -> DataFrame:
    """Read pairs (BEDPE) of one chromosome to fragments, moved whole: by `plus` to the right where the first mate is on +, else by
    `minus` to the left, both ends stopping at 0."""
    lo, hi = F.least("start1", "start2"), F.greatest("stop1", "stop2")
    move = lambda x: F.when(F.col("strand1") == "+", x + plus).otherwise(F.greatest(F.lit(0), x - minus))
    return pairs.where("chr1 = chr2").select(F.col("chr1").alias("chr"), move(lo).alias("start"), move(hi).alias("stop"), "name", F.col("strand1").alias("strand")).where("start < stop")


def exon_span(exons: DataFrame) -> DataFrame:
    """Summed exon span per gene: every exon row counts, overlaps included."""
    return exons.groupBy("gene_id").agg(F.sum(F.abs(F.col("stop") - F.col("start"))).alias("exon_span"))


def select_regions(regions: DataFrame, min_width: int, min_samples: int, min_density: float, quantile: float) -> DataFrame:
    """Width and sample filters first; the density quantile is taken over what they keep."""
    kept = regions.where((F.col("width") >= min_width) & (F.col("n_samples") >= min_samples)).withColumn("density", F.col("n_fragments") / F.col("width"))
    cut = kept.agg(F.greatest(F.lit(min_density), F.percentile("density", quantile)).alias("__cut"))
    return kept.crossJoin(F.broadcast(cut)).where("density >= __cut").drop("__cut")
