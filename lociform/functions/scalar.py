"""Column helpers: rounding, ranks, text and tail probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def signif(x: Column, digits: int = 3) -> Column:
    """Round to significant digits, half to even."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x / p, 0) * p)


def strip_version(name: Column) -> Column:
    """ENSG01.12 -> ENSG01."""
    return F.regexp_replace(name, r"\.[0-9]+$", "")


def average_rank(by: list[str], value: str) -> Column:
    """Average-tie rank of `value` within `by`, ascending."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def complement(sequence: Column) -> Column:
    return F.translate(sequence, "ACGTacgt", "TGCAtgca")


def longest_run(sequence: Column, letter: str) -> Column:
    runs = F.regexp_extract_all(sequence, F.lit(f"({letter}+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("bigint")


def ratio_text(text: Column) -> Column:
    """'3/40' as a number."""
    parts = F.split(text, "/")
    return F.try_divide(F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double"))


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("p < 0.001")).otherwise(F.concat(F.lit("p = "), F.format_number(p, 3)))


def log2_fold(a: Column, b: Column, pseudo: float = 1.0) -> Column:
    return F.log2((a + pseudo) / (b + pseudo))


# --- tails, written out because no statistics library is present ---------------------------------------------


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def hypergeom_tail(k: int, total: int, marked: int, drawn: int) -> float:
    """P(at least k marked among `drawn`)."""
    lc = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    whole = lc(total, drawn)
    return min(1.0, sum(math.exp(lc(marked, i) + lc(total - marked, drawn - i) - whole) for i in range(max(k, drawn - (total - marked)), min(marked, drawn) + 1)))
