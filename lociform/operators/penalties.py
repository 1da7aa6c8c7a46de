"""Penalty functions as columns, and small dense solvers of canonical correlation on the driver's side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def soft(x: Column, tau: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - tau, F.lit(0.0))


def scad(x: Column, lam: float, a: float = 3.7) -> Column:
    mid = ((a - 1) * x - F.signum(x) * a * lam) / (a - 2)
    return F.when(F.abs(x) <= 2 * lam, soft(x, lam)).when(F.abs(x) <= a * lam, mid).otherwise(x)


def proximal_lasso(x: Column, old: Column, tau: float) -> Column:
    """Shrunken x outside the dead zone, the old weight inside it."""
    return F.when(F.abs(x) > tau, soft(x, tau)).otherwise(old)


def proximal_elastic(x: Column, old: Column, tau: float, tau_en: float, mu: float = 1.0) -> Column:
    """x = omega + mu c, shrunken by mu tau_en and scaled by the ridge part 1 + 2 mu tau; the old weight in the dead zone."""
    return F.when(F.abs(x) > mu * tau_en, soft(x, mu * tau_en) / (1 + 2 * mu * tau)).otherwise(old)


def proximal_scad(x: Column, old: Column, tau: float, mu: float = 1.0, a: float = 3.7) -> Column:
    """x = omega + mu c: soft-thresholded while the result stays within tau, then the rescaled middle piece up to a tau, then x
    itself; the old weight where no piece applies."""
    e1, e2 = -1 / (2 * (a - 1)), 2 * a * tau / (2 * (a - 1))
    up, down = x - mu * tau, x + mu * tau
    mid_up, mid_down = (x - mu * e2) / (1 + 2 * mu * e1), (x + mu * e2) / (1 + 2 * mu * e1)
    return (
        F.when((up > 0) & (up <= tau), up).when((down >= -tau) & (down < 0), down)
        .when((mid_up > tau) & (mid_up <= a * tau), mid_up).when((mid_down >= -a * tau) & (mid_down <= -tau), mid_down)
        .when(F.abs(x) > a * tau, x).otherwise(old)
    )


def sparsity_quality(share: Column, low: float = 0.05, high: float = 0.30, steepness: float = 2.0) -> Column:
    """1 while the share of selected features lies in [low, high], falling off exponentially on both sides."""
    below, above = F.exp(-steepness * (low - share) / low), F.exp(-steepness * (share - high) / (1 - high))
    return F.when(share < low, below).when(share > high, above).when(share.isNotNull(), F.lit(1.0))


def folds(df: DataFrame, key: str, k: int, seed: int = 1, bins: int = 1024) -> DataFrame:
    """`df` (one row a key) with `fold` 0..k-1: rows in the order of a hash of the key, cut into k folds whose sizes differ by one
    at most. The place in that order is that in a bin of the hash plus the counts of the bins before."""
    x = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__bin", F.pmod(F.col("__h"), F.lit(bins)))
    c = x.groupBy("__bin").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__bin")  # as many rows as bins
    c = c.select("__bin", (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__bin").orderBy("__h", key)) - 1
    return x.join(F.broadcast(c), "__bin").withColumn("fold", F.floor(place * k / F.col("__all")).cast("int")).drop("__h", "__bin", "__before", "__all")


def matrix_power(m: np.ndarray, p: float) -> np.ndarray:
    """Real power of a symmetric matrix; non-positive eigenvalues drop."""
    value, vector = np.linalg.eigh((m + m.T) / 2)
    ok = value > 1e-12 * max(1.0, np.abs(value).max())
    return (vector[:, ok] * value[ok] ** p) @ vector[:, ok].T


def pseudo_inverse(m: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    u, s, v = np.linalg.svd(m, full_matrices=False)
    ok = s > tolerance * s.max(initial=0)
    return (v[ok].T / s[ok]) @ u[:, ok].T


def unit_ball(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1 else v


def multi_cca(views: list[np.ndarray], taus: list[float], components: int = 1, rounds: int = 200) -> list[np.ndarray]:
    """Sparse canonical vectors of several views (rows are samples): cyclic soft-thresholded steps on the summed cross
    covariances; further components on views without the found scores."""
    x = [(v - v.mean(0)) / (v.std(0) + 1e-12) for v in views]
    found: list[list[np.ndarray]] = [[] for _ in x]
    for _ in range(components):
        w = [np.linalg.svd(v, full_matrices=False)[2][0] for v in x]
        for _ in range(rounds):
            old = [v.copy() for v in w]
            for i in range(len(x)):
                target = sum(x[j] @ w[j] for j in range(len(x)) if j != i)
                new = x[i].T @ target / len(target)
                new = np.sign(new) * np.maximum(np.abs(new) - taus[i] * np.abs(new).max(initial=0), 0)
                n = np.linalg.norm(new)
                w[i] = new / n if n else new
            if max(np.abs(a - b).max() for a, b in zip(w, old, strict=True)) < 1e-7:
                break
        for i, v in enumerate(w):
            found[i].append(v)
            score = x[i] @ v
            if (n := score @ score) > 0:
                x[i] = x[i] - np.outer(score, score @ x[i]) / n
    return [np.array(f).T for f in found]


def project_factors(values: dict[str, np.ndarray], weights: dict[str, np.ndarray], means: dict[str, np.ndarray]) -> np.ndarray | None:
    """Factor scores of one sample from the views it has, by least squares on the stacked weights."""
    views = [v for v in values if v in weights]
    if not views:
        return None
    w = np.vstack([weights[v] for v in views])
    y = np.concatenate([values[v] - means[v] for v in views])
    ok = np.isfinite(y)
    return np.linalg.lstsq(w[ok], y[ok], rcond=None)[0] if ok.sum() >= w.shape[1] else None


def remove_unwanted(values: np.ndarray, controls: np.ndarray, k: int) -> np.ndarray:
    """Regress the k leading factors of the control rows (features x samples) out of all rows."""
    c = values[controls] - values[controls].mean(1, keepdims=True)
    f = np.linalg.svd(c, full_matrices=False)[2][:k].T
    centre = values.mean(1, keepdims=True)
    return values - (values - centre) @ f @ f.T
