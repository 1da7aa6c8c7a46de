"""Model fits per group through pandas, and small dense linear algebra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normal_tail, t_two_sided

FIT = "feature_id string, term string, estimate double, std_error double, stat double, pvalue double"


def ols_per_feature(values: DataFrame, terms: list[str], key: str = "feature_id") -> DataFrame:
    """value ~ 1 + terms (numeric columns) for each feature; a group holds one feature's samples, which are few."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=["value", *terms])
        x = np.column_stack([np.ones(len(p)), *(p[t].to_numpy(float) for t in terms)])
        df = len(p) - x.shape[1]
        names = ["intercept", *terms]
        if df < 1 or np.linalg.matrix_rank(x) < x.shape[1]:
            return pd.DataFrame(columns=["feature_id", "term", "estimate", "std_error", "stat", "pvalue"])
        beta, *_ = np.linalg.lstsq(x, p["value"].to_numpy(float), rcond=None)
        res = p["value"].to_numpy(float) - x @ beta
        se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (res @ res) / df)
        t = np.divide(beta, se, out=np.full(len(beta), np.nan), where=se > 0)
        return pd.DataFrame({"feature_id": p[key].iloc[0], "term": names, "estimate": beta, "std_error": se, "stat": t, "pvalue": [t_two_sided(v, df) if v == v else None for v in t]})

    return values.groupBy(key).applyInPandas(fit, FIT)


def negative_binomial(counts: DataFrame, group: str = "grp", factor: str = "size_factor", dispersion: float | None = None) -> DataFrame:
    """Two-group negative-binomial regression of each feature with size factors: log2 fold change and a Wald test.

    Dispersion by moments inside the groups unless given; iteratively reweighted least squares on the log scale.
    """

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        y, s = p["value"].to_numpy(float), p[factor].to_numpy(float)
        levels = sorted(p[group].unique())
        out = {"feature_id": p["feature_id"].iloc[0], "term": group}
        if len(levels) != 2 or not y.any():
            return pd.DataFrame([out | {"estimate": None, "std_error": None, "stat": None, "pvalue": None}])
        x = np.column_stack([np.ones(len(y)), (p[group] == levels[1]).to_numpy(float)])
        z = y / s
        a = dispersion
        if a is None:
            over = within = 0.0
            for level in levels:
                part = z[(p[group] == level).to_numpy()]
                if len(part) > 1:
                    over += (len(part) - 1) * (part.var(ddof=1) - part.mean() * (1 / s).mean())
                    within += (len(part) - 1) * part.mean() ** 2
            a = max(1e-8, over / within) if within else 1e-8
        mu = np.maximum(y, 0.1)
        beta = np.zeros(2)
        for _ in range(50):
            w = mu / (1 + a * mu)
            work = np.log(mu / s) + (y - mu) / mu
            new = np.linalg.solve(x.T @ (w[:, None] * x) + 1e-9 * np.eye(2), x.T @ (w * work))
            done = np.abs(new - beta).max() < 1e-9
            beta = new.clip(-30, 30)
            mu = np.maximum(s * np.exp(x @ beta), 1e-9)
            if done:
                break
        se = math.sqrt(np.linalg.inv(x.T @ ((mu / (1 + a * mu))[:, None] * x) + 1e-9 * np.eye(2))[1, 1])
        stat = beta[1] / se
        return pd.DataFrame([out | {"estimate": beta[1] / math.log(2), "std_error": se / math.log(2), "stat": stat, "pvalue": 2 * normal_tail(abs(stat))}])

    return counts.groupBy("feature_id").applyInPandas(fit, FIT)


def moderated_t(fits: DataFrame, df: int) -> DataFrame:
    """Shrink squared standard errors towards their mean over features by empirical Bayes with prior df of the moment estimate."""
    s = fits.where("std_error > 0").withColumn("lv", F.log(F.col("std_error") * F.col("std_error")))
    prior = s.agg(F.avg("lv").alias("m"), F.var_samp("lv").alias("v"))
    x = s.crossJoin(F.broadcast(prior))
    d0 = F.greatest(F.lit(1.0), F.try_divide(F.lit(2.0), F.greatest(F.col("v") - 2.0 / df, F.lit(0.05))))
    var = (d0 * F.exp("m") + df * F.exp("lv")) / (d0 + df)
    return x.select("feature_id", "term", "estimate", (F.col("estimate") / F.sqrt(var)).alias("t"), (d0 + df).alias("df"))


def pca(points: DataFrame, k: int) -> DataFrame:
    """Principal components of (id, vec): id, component, score, explained. The covariance is summed in Spark (its size is
    that of the dimensions, not of the rows) and decomposed on the driver; the largest loading of a component is positive."""
    first = points.where("vec IS NOT NULL").select(F.size("vec").alias("d")).first()
    if first is None:
        return points.sparkSession.createDataFrame([], "id bigint, component int, score double, explained double")
    d = first.d

    def moments(parts):
        import pyarrow as pa

        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for b in parts:
            x = np.array(b.column(0).flatten(), float).reshape(-1, d)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], names=["n", "s", "q"])

    rows = points.where("vec IS NOT NULL").select("vec").mapInArrow(moments, "n bigint, s array<double>, q array<double>")
    x = rows.select("n", F.posexplode(F.concat("s", "q")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    n = x[0].n
    flat = np.array([r.v for r in x])
    mean, cov = flat[:d] / n, (flat[d:].reshape(d, d) - np.outer(flat[:d], flat[:d]) / n) / max(1, n - 1)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)[:k]
    share = value[order] / value.sum()
    load = vector[:, order] * np.sign(vector[np.abs(vector[:, order]).argmax(0), order])

    def project(parts):
        import pyarrow as pa

        for b in parts:
            y = (np.array(b.column(1).flatten(), float).reshape(-1, d) - mean) @ load
            ids = np.repeat(b.column(0).to_numpy(), len(order))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(1, len(order) + 1, dtype=np.int32), len(y))), pa.array(y.ravel()), pa.array(np.tile(share, len(y)))], names=["id", "component", "score", "explained"])

    return points.where("vec IS NOT NULL").select("id", "vec").mapInArrow(project, "id bigint, component int, score double, explained double")


def soft_threshold(x: np.ndarray, lam: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - lam, 0)


def scad_threshold(x: np.ndarray, lam: float, a: float = 3.7) -> np.ndarray:
    mid = ((a - 1) * x - np.sign(x) * a * lam) / (a - 2)
    return np.where(np.abs(x) <= 2 * lam, soft_threshold(x, lam), np.where(np.abs(x) <= a * lam, mid, x))


def sparse_cca(x: np.ndarray, y: np.ndarray, lam_x: float, lam_y: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """First pair of sparse canonical vectors by alternating soft-thresholded power steps on the cross covariance."""
    x, y = (x - x.mean(0)) / (x.std(0) + 1e-12), (y - y.mean(0)) / (y.std(0) + 1e-12)
    c = x.T @ y / max(1, len(x) - 1)
    v = np.linalg.svd(c, full_matrices=False)[2][0]
    u = np.zeros(c.shape[0])
    for _ in range(rounds):
        new = soft_threshold(c @ v, lam_x)
        if not (n := np.linalg.norm(new)):
            return np.zeros(c.shape[0]), np.zeros(c.shape[1]), 0.0
        new /= n
        v = soft_threshold(c.T @ new, lam_y)
        if not (n := np.linalg.norm(v)):
            return new, np.zeros(c.shape[1]), 0.0
        v /= n
        done = np.abs(new - u).max() < 1e-8
        u = new
        if done:
            break
    a, b = x @ u, y @ v
    return u, v, float(np.corrcoef(a, b)[0, 1])


def cca_grid(views: DataFrame, grid: list[tuple[float, float]], folds: int = 3) -> DataFrame:
    """Cross-validated sparse CCA over penalties: each (penalty pair, fold) is a task on the bounded matrix of views
    (sample, view in x/y, feature, value); mean held-out correlation per pair."""
    spark = views.sparkSession
    w = views.groupBy("sample", "view").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    rows = w.groupBy().agg(F.collect_list(F.struct("sample", "view", "m")).alias("rows"))
    tasks = spark.createDataFrame([(a, b, f) for a, b in grid for f in range(folds)], "lam_x double, lam_y double, fold int")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r = p.iloc[0]
        table = {(q["sample"], q["view"]): dict(q["m"]) for q in r["rows"]}
        samples = sorted({s for s, v in table if v == "x"} & {s for s, v in table if v == "y"})
        mats = []
        for view in ("x", "y"):
            feats = sorted({f for s in samples for f in table[s, view]})
            mats.append(np.array([[table[s, view].get(f, 0.0) for f in feats] for s in samples]))
        hold = np.arange(len(samples)) % folds == r["fold"]
        u, v, _ = sparse_cca(mats[0][~hold], mats[1][~hold], r["lam_x"], r["lam_y"])
        a, b = mats[0][hold] @ u, mats[1][hold] @ v
        c = float(np.corrcoef(a, b)[0, 1]) if len(a) > 2 and a.std() > 0 and b.std() > 0 else 0.0
        return pd.DataFrame({"lam_x": [r["lam_x"]], "lam_y": [r["lam_y"]], "fold": [r["fold"]], "correlation": [c]})

    out = tasks.crossJoin(rows).groupBy("lam_x", "lam_y", "fold").applyInPandas(run, "lam_x double, lam_y double, fold int, correlation double")
    return out.groupBy("lam_x", "lam_y").agg(F.avg("correlation").alias("mean_correlation"), F.count(F.lit(1)).alias("folds"))
