"""Grouped statistics: ranks, correlation, tests, multiple testing, outliers, consensus and transitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def bh(df: DataFrame, p: str = "pvalue", by: list[str] | None = None, out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg within `by`; NULL p-values stay NULL and do not count.

    Only distinct p-values are ranked, so ties and a large family cost one row each.
    """
    by = by or []
    d = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by)
    d = d.withColumn("__r", F.sum("__n").over(w.orderBy(p)))
    d = d.withColumn("__m", F.sum("__n").over(w))
    d = d.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(w.orderBy(F.col(p).desc()))))
    return df.join(d.drop("__n", "__r", "__m"), [*by, p], "left")


def binned_rank(df: DataFrame, value: str, width: float, out: str = "rank") -> DataFrame:
    """`df` with the average-tie rank of `value` over all rows and `n_rows`: ranked inside bins of the value, with the
    counts of the bins before carried in, so no task sorts the whole table."""
    b = df.withColumn("__bin", F.floor(F.col(value) / width))
    c = b.groupBy("__bin").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__bin")  # as many rows as bins
    c = c.select("__bin", (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("n_rows"))
    return b.join(c, "__bin").withColumn(out, F.col("__before") + S.average_rank(["__bin"], value)).drop("__bin", "__before")


def ordered_rank(df: DataFrame, by: list[str], value: str, tie: str, bins: int = 64) -> DataFrame:
    """`df` with `rank` (1.. by descending value, ties by `tie`) and the number `n` of rows, within `by`; no task sorts a whole list:
    rows are ranked between approximate quantiles, and the counts of the stretches before are carried in."""
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [k / bins for k in range(1, bins)], 1000).alias("__cuts"))
    x = df.join(cuts, by) if by else df.crossJoin(F.broadcast(cuts))
    x = x.withColumn("__bin", F.size(F.filter("__cuts", lambda c: c > F.col(value)))).drop("__cuts")
    c = x.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by)
    c = c.select(*by, "__bin", (F.sum("__n").over(w.orderBy("__bin")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("n"))
    place = F.row_number().over(Window.partitionBy(*by, "__bin").orderBy(F.col(value).desc(), tie))
    return x.join(c, [*by, "__bin"]).withColumn("rank", (F.col("__before") + place).cast("int")).drop("__bin", "__before")


def bonferroni(p: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), p * n)


def correlation_pairs(values: DataFrame, method: str = "pearson", least: int = 3) -> DataFrame:
    """Correlation of every pair of variables (variable, item, value) over the items that both have.

    Pairs of variables are the result, so callers bound the variables first (for instance by variance).
    """
    v = values.where("value IS NOT NULL")
    p = v.alias("a").join(v.alias("b"), (F.col("a.item") == F.col("b.item")) & (F.col("a.variable") < F.col("b.variable")))
    p = p.select(F.col("a.variable").alias("x"), F.col("b.variable").alias("y"), F.col("a.value").alias("u"), F.col("b.value").alias("v"))
    if method == "spearman":
        p = p.withColumns({"u": S.average_rank(["x", "y"], "u"), "v": S.average_rank(["x", "y"], "v")})
    g = p.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.corr("u", "v").alias("r"))
    return g.where(F.col("n") >= least)


def tails(df: DataFrame, kind: str, args: list[str], out: str = "pvalue") -> DataFrame:
    """Add a p-value from statistic columns: t (t, df), chi2 (x, df), f (f, df1, df2), z (z), hyper (k, total, marked, drawn)."""
    f = {"t": S.t_two_sided, "chi2": S.chi2_tail, "f": S.f_tail, "z": lambda z: 2 * S.normal_tail(abs(z)), "hyper": lambda *a: S.hypergeom_tail(*map(int, a))}[kind]

    @F.pandas_udf("double")
    def tail(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if any(x is None or x != x for x in r) else f(*r) for r in part.itertuples(index=False)], dtype="float64")

    return df.withColumn(out, tail(F.struct(*[F.col(a).cast("double").alias(a) for a in args])))


def rank_sum(values: DataFrame, by: list[str], group: str = "grp", a: str = "a", b: str = "b") -> DataFrame:
    """Wilcoxon rank-sum of groups a and b per `by`: n_a, n_b, u and the tie-corrected normal z."""
    v = values.where(F.col(group).isin(a, b) & F.col("value").isNotNull()).withColumn("r", S.average_rank(by, "value"))
    ties = v.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    g = v.groupBy(*by).agg(F.count_if(F.col(group) == a).alias("n_a"), F.count_if(F.col(group) == b).alias("n_b"), F.sum(F.when(F.col(group) == a, F.col("r"))).alias("s")).join(ties, by)
    n = F.col("n_a") + F.col("n_b")
    u = F.col("s") - F.col("n_a") * (F.col("n_a") + 1) / 2
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12.0 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0))))
    return g.withColumn("u", u).withColumn("z", F.try_divide(F.col("u") - F.col("n_a") * F.col("n_b") / 2.0, sd)).select(*by, "n_a", "n_b", "u", "z")


def signed_rank(values: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    """Wilcoxon signed-rank of non-zero differences: n, w_plus and the tie-corrected z."""
    v = values.where((F.col(column) != 0) & F.col(column).isNotNull()).withColumn("__a", F.abs(column))
    v = v.withColumn("r", S.average_rank(by, "__a"))
    ties = v.groupBy(*by, "__a").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    g = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(column) > 0, F.col("r")).otherwise(0.0)).alias("w_plus")).join(ties, by)
    n = F.col("n")
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4.0, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0))
    return g.select(*by, "n", "w_plus", z.alias("z"))


def kruskal(values: DataFrame, by: list[str], group: str = "grp") -> DataFrame:
    """Kruskal-Wallis: n, k, h (tie-corrected), and both effect sizes, h / (n - 1) and (h - k + 1) / (n - k)."""
    v = values.where(F.col("value").isNotNull() & F.col(group).isNotNull()).withColumn("r", S.average_rank(by, "value"))
    per = v.groupBy(*by, group).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("m"))
    h0 = per.groupBy(*by).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"))
    ties = v.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = F.try_divide(12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    x = h0.join(ties, by).withColumn("h", h)
    return x.select(*by, "n", "k", "h", F.try_divide(F.col("h"), n - 1).alias("epsilon2"), F.try_divide(F.col("h") - F.col("k") + 1, n - F.col("k")).alias("eta2"))


def chi_square(table: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Chi-square of two categorical columns, NULL levels left out: n, chi2, df, cramers_v.

    Empty cells are not built: a cell's term is o^2 / e, and their sum less n is the statistic.
    """
    by = by or []
    c = table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = c.groupBy(*by, a).agg(F.sum("o").alias("ra"))
    rb = c.groupBy(*by, b).agg(F.sum("o").alias("rb"))
    x = c.join(ra, [*by, a]).join(rb, [*by, b])
    g = x.groupBy(*by).agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb")).cast("double")).alias("q"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    chi2 = F.col("n") * (F.col("q") - 1)
    df = (F.col("ka") - 1) * (F.col("kb") - 1)
    low = F.least(F.col("ka"), F.col("kb")) - 1
    return g.select(*by, "n", chi2.alias("chi2"), df.alias("df"), F.sqrt(F.try_divide(F.greatest(chi2, F.lit(0.0)), F.col("n") * low)).alias("cramers_v"))


def welch_t(values: DataFrame, by: list[str], group: str = "grp", a: str = "a", b: str = "b") -> DataFrame:
    """Welch's t per `by`: diff, t and its degrees of freedom, from one pass of conditional moments."""
    m = lambda g, f: f(F.when(F.col(group) == g, F.col("value")))
    g = values.groupBy(*by).agg(m(a, F.avg).alias("ma"), m(b, F.avg).alias("mb"), m(a, F.var_samp).alias("va"), m(b, F.var_samp).alias("vb"), m(a, F.count).alias("na"), m(b, F.count).alias("nb"))
    sa, sb = F.try_divide(F.col("va"), F.col("na")), F.try_divide(F.col("vb"), F.col("nb"))
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(sa + sb))
    df = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("na") - 1) + sb * sb / (F.col("nb") - 1))
    return g.where("na > 1 AND nb > 1").select(*by, "na", "nb", (F.col("ma") - F.col("mb")).alias("diff"), t.alias("t"), df.alias("df"))


def anova(values: DataFrame, by: list[str], group: str = "grp") -> DataFrame:
    """One-way F per `by`: f, df1, df2, eta2."""
    per = values.where(F.col("value").isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"))
    w = Window.partitionBy(*by)
    per = per.withColumn("g", F.sum(F.col("m") * F.col("n")).over(w) / F.sum("n").over(w))
    s = per.groupBy(*by).agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("sb"), F.sum(F.col("n") * F.col("v")).alias("sw"), (F.count(F.lit(1)) - 1).alias("df1"), (F.sum("n") - F.count(F.lit(1))).alias("df2"))
    return s.select(*by, F.try_divide(F.try_divide(F.col("sb"), F.col("df1")), F.try_divide(F.col("sw"), F.col("df2"))).alias("f"), "df1", "df2", F.try_divide(F.col("sb"), F.col("sb") + F.col("sw")).alias("eta2"))


def mad(values: DataFrame, by: list[str], constant: float = 1.4826) -> DataFrame:
    """Median and median absolute deviation of `value` per `by`; constant is 1 in outlier rules."""
    m = values.groupBy(*by).agg(F.percentile("value", 0.5).alias("median"))
    d = values.join(m, by).groupBy(*by).agg((F.percentile(F.abs(F.col("value") - F.col("median")), 0.5) * constant).alias("mad"))
    return m.join(d, by)


def outliers(values: DataFrame, by: list[str], how: str = "iqr", k: float = 1.5) -> DataFrame:
    """Rows with `outlier`: beyond k interquartile ranges of the quartiles, or k MADs of the median."""
    if how == "iqr":
        q = values.groupBy(*by).agg(F.percentile("value", [0.25, 0.75]).alias("q")).select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
        x = values.join(q, by)
        r = F.col("hi") - F.col("lo")
        return x.withColumn("outlier", (F.col("value") < F.col("lo") - k * r) | (F.col("value") > F.col("hi") + k * r)).drop("lo", "hi")
    x = values.join(mad(values, by, 1.0), by)
    return x.withColumn("outlier", F.abs(F.col("value") - F.col("median")) > k * F.col("mad")).drop("median", "mad")


def item_consensus(assignments: DataFrame) -> DataFrame:
    """(item, run, cluster) to the mean share of runs in which an item meets the others of its most frequent cluster mates:
    item, n_pairs, consensus. Pairs meet within a run's cluster; callers bound the items, as pairs are the result."""
    a = assignments
    both = a.alias("x").join(a.alias("y"), (F.col("x.run") == F.col("y.run")) & (F.col("x.item") != F.col("y.item")))
    p = both.groupBy(F.col("x.item").alias("item"), F.col("y.item").alias("other")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("x.cluster") == F.col("y.cluster")).alias("together"))
    return p.groupBy("item").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("together") / F.col("runs")).alias("consensus"))


def transitions(assignments: DataFrame) -> DataFrame:
    """(item, step, cluster): counts from cluster to cluster of the next step, and their share of the origin."""
    w = Window.partitionBy("item").orderBy("step")
    t = assignments.withColumns({"to": F.lead("cluster").over(w), "next": F.lead("step").over(w)}).where("next IS NOT NULL")
    g = t.groupBy("step", F.col("cluster").alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("step", "from")))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of level pairs with row shares; NULL levels drop."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def elbow(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The point furthest from the chord between the first and the last."""
    ends = df.agg(F.min_by(F.struct(x, y), x).alias("a"), F.max_by(F.struct(x, y), x).alias("b"))
    d = F.abs((F.col(f"b.{y}") - F.col(f"a.{y}")) * F.col(x) - (F.col(f"b.{x}") - F.col(f"a.{x}")) * F.col(y) + F.col(f"b.{x}") * F.col(f"a.{y}") - F.col(f"b.{y}") * F.col(f"a.{x}"))
    d = F.try_divide(d, F.sqrt(F.pow(F.col(f"b.{y}") - F.col(f"a.{y}"), 2.0) + F.pow(F.col(f"b.{x}") - F.col(f"a.{x}"), 2.0)))
    return df.crossJoin(F.broadcast(ends)).withColumn("distance", d).drop("a", "b").orderBy(F.col("distance").desc(), x).limit(1)


def grid(**axes: list) -> list[dict]:
    """All combinations of parameter values."""
    import itertools

    return [dict(zip(axes, v, strict=True)) for v in itertools.product(*axes.values())]
