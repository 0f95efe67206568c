"""Grouped pandas statistics: seeded resampling and iterative fits, which no built-in expresses.

Each group handed to pandas is small by construction: one unit's velocities, or the per-cluster curve sums of
one hour, which are aggregated by Spark first. Seeds derive from the group's label, so results do not depend
on partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_REPLICATES = 20


def group_seed(seed: int, *label: object) -> int:
    text = "|".join(f"{x:g}" if isinstance(x, float) else str(x) for x in label)
    return (seed + zlib.crc32(text.encode())) % (2**32 - 1)


def percentile_interval(values: np.ndarray, confidence: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the finite replicates; NaN with fewer than LEAST_REPLICATES of them."""
    v = values[np.isfinite(values)]
    if len(v) < LEAST_REPLICATES:
        return float("nan"), float("nan")
    tail = (1 - confidence) / 2
    return tuple(np.quantile(v, [tail, 1 - tail]))


def bounded_minimum(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-7) -> float:
    """Minimum of f on [low, high]: a grid brackets it, golden sections close in."""
    grid = np.linspace(low, high, 41)
    k = int(np.argmin([f(x) for x in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, 40)]
    g = (np.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return float((a + b) / 2)


def fbm(x: np.ndarray, alpha: float) -> np.ndarray:
    return (np.abs(x - 1) ** alpha + np.abs(x + 1) ** alpha - 2 * np.abs(x) ** alpha) / 2


def shuffled_persistence(velocities: DataFrame, shuffles: int = 100, degrees: float = 30.0, seed: int = 0) -> DataFrame:
    """Turning persistence of each unit and site, and its mean and interval when the velocity vectors are
    permuted inside the trajectory while the vertices stay. A trajectory is bounded by its movie."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[(pdf.vx != 0) | (pdf.vy != 0)].sort_values("start_frame")
        v = pdf[["vx", "vy"]].to_numpy()
        u = v / np.sqrt((v**2).sum(1))[:, None]
        at = {f: i for i, f in enumerate(pdf.start_frame)}
        turns = [(i, at[e]) for i, e in enumerate(pdf.end_frame) if e in at]
        if not turns:
            return pd.DataFrame({"unit_id": [key[0]], "site": [key[1]], "turns": [0], "persistence": [None], "null_mean": [None], "null_low": [None], "null_high": [None]}).astype({"persistence": float, "null_mean": float, "null_low": float, "null_high": float})
        a, b = np.array(turns).T
        limit = np.cos(np.radians(degrees))
        score = lambda w: float(((w[a] * w[b]).sum(1) >= limit).mean() - ((w[a] * w[b]).sum(1) <= -limit).mean())
        rng = np.random.default_rng(group_seed(seed, *key))
        null = np.array([score(u[rng.permutation(len(u))]) for _ in range(shuffles)])
        low, high = percentile_interval(null)
        return pd.DataFrame({"unit_id": [key[0]], "site": [key[1]], "turns": [len(turns)], "persistence": [score(u)], "null_mean": [null.mean()], "null_low": [low], "null_high": [high]})

    schema = "unit_id string, site string, turns long, persistence double, null_mean double, null_low double, null_high double"
    return velocities.select("unit_id", "site", "start_frame", "end_frame", "vx", "vy").groupBy("unit_id", "site").applyInPandas(one, schema)


def cluster_sums(df: DataFrame, keys: Sequence[str], cluster: str, value: str, x: str | None = None) -> DataFrame:
    """(keys, cluster[, x], total, n): what a cluster bootstrap of means needs, aggregated by Spark, so that a
    group in pandas holds one row per cluster (and x) however many rows the cluster has."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, cluster, *([x] if x else [])).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def bootstrap_means(df: DataFrame, keys: Sequence[str], cluster: str, value: str, iterations: int = 500, seed: int = 0) -> DataFrame:
    """Mean of value per group with a percentile interval from resampling whole clusters (sorted as text)."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", clusters long, mean double, low double, high double"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_c=pdf[cluster].astype(str)).sort_values("_c")
        total, n = pdf.total.to_numpy(float), pdf.n.to_numpy(float)
        rng = np.random.default_rng(group_seed(seed, *key))
        pick = rng.integers(0, len(n), (iterations, len(n)))
        means = total[pick].sum(1) / n[pick].sum(1)
        low, high = percentile_interval(means) if len(n) > 1 else (float("nan"), float("nan"))
        return pd.DataFrame([[*key, len(n), total.sum() / n.sum(), low, high]], columns=[*keys, "clusters", "mean", "low", "high"])

    return cluster_sums(df, keys, cluster, value).groupBy(*keys).applyInPandas(one, schema)


def cluster_bootstrap(df: DataFrame, keys: Sequence[str], cluster: str, statistic: Callable[[pd.DataFrame], float], iterations: int = 2000, confidence: float = 0.95, seed: int = 0, columns: Sequence[str] = ()) -> DataFrame:
    """Any statistic of a resampled table: for groups that are small after aggregation (per-cluster rows).
    At least 100 iterations and, per group, two clusters; groups with one cluster give no interval."""
    if iterations < 100:
        raise ValueError("at least 100 iterations")
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", clusters long, estimate double, low double, high double"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g for _, g in pdf.assign(_c=pdf[cluster].astype(str)).groupby("_c", sort=True)]
        rng = np.random.default_rng(group_seed(seed, *key))
        got = np.full(iterations, np.nan)
        if len(parts) > 1:
            for i in range(iterations):
                got[i] = statistic(pd.concat([parts[j] for j in rng.integers(0, len(parts), len(parts))]))
        low, high = percentile_interval(got, confidence)
        return pd.DataFrame([[*key, len(parts), statistic(pdf), low, high]], columns=[*keys, "clusters", "estimate", "low", "high"])

    return df.select(*dict.fromkeys([*keys, cluster, *columns])).groupBy(*keys).applyInPandas(one, schema)


def fit_fbm(curves: DataFrame, keys: Sequence[str], low: float = 0.05, high: float = 1.95, last_x: float = 5.1, least_points: int = 2, weighted: bool = False) -> DataFrame:
    """Exponent of fractional Brownian motion per group from points (x, value[, weight]) with 0 < x <= last_x."""
    kinds = dict(curves.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", points long, alpha double, rmse double"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.x.to_numpy(float), pdf.value.to_numpy(float)
        w = pdf.weight.to_numpy(float) if weighted else np.ones(len(x))
        ok = np.isfinite(x) & np.isfinite(y) & (x > 0) & (x <= last_x) & (w > 0)
        x, y, w = x[ok], y[ok], w[ok]
        if len(x) < least_points:
            return pd.DataFrame([[*key, len(x), np.nan, np.nan]], columns=[*keys, "points", "alpha", "rmse"])
        loss = lambda a: float((w * (y - fbm(x, a)) ** 2).sum() / w.sum())
        alpha = bounded_minimum(loss, low, high)
        return pd.DataFrame([[*key, len(x), alpha, np.sqrt(loss(alpha))]], columns=[*keys, "points", "alpha", "rmse"])

    return curves.groupBy(*keys).applyInPandas(one, schema)


def bootstrap_fbm(curves: DataFrame, keys: Sequence[str], cluster: str, unit: str, iterations: int = 300, seed: int = 0, low: float = 0.25, high: float = 1.0, last_x: float = 2.5) -> DataFrame:
    """fBM exponent of each group's mean curve with a cluster-bootstrap interval. curves: keys, cluster, unit, x, value -
    x being a bin center, so that a group holds clusters x bins sums. A unit's values at one x are averaged first; the
    bins of the mean curve weigh as many units as they have, those of a cluster drawn twice counting twice."""
    kinds = dict(curves.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", clusters long, alpha double, low double, high double"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf.pivot_table(index=pdf[cluster].astype(str), columns="x", values="total", aggfunc="sum").fillna(0).sort_index()
        n = pdf.pivot_table(index=pdf[cluster].astype(str), columns="x", values="n", aggfunc="sum").fillna(0).sort_index()
        x = total.columns.to_numpy(float)
        use = (x > 0) & (x <= last_x)
        t, c, x = total.to_numpy()[:, use], n.to_numpy()[:, use], x[use]

        def alpha(rows: np.ndarray) -> float:
            k = c[rows].sum(0)
            if (k > 0).sum() < 3:
                return float("nan")
            y = t[rows].sum(0)[k > 0] / k[k > 0]
            w = k[k > 0] / k.sum()
            return bounded_minimum(lambda a: float((w * (y - fbm(x[k > 0], a)) ** 2).sum()), low, high, 1e-5)

        rng = np.random.default_rng(group_seed(seed, *key))
        every = np.arange(len(t))
        got = np.array([alpha(rng.integers(0, len(t), len(t))) for _ in range(iterations)]) if len(t) > 1 else np.array([])
        lo, hi = percentile_interval(got)
        return pd.DataFrame([[*key, len(t), alpha(every), lo, hi]], columns=[*keys, "clusters", "alpha", "low", "high"])

    each = curves.where(F.col("value").isNotNull()).groupBy(*keys, cluster, unit, "x").agg(F.avg("value").alias("value"))
    return cluster_sums(each, keys, cluster, "value", "x").groupBy(*keys).applyInPandas(one, schema)


def bootstrap_window_means(bins: DataFrame, keys: Sequence[str], cluster: str, lower: float, upper: float, iterations: int = 500, seed: int = 0) -> DataFrame:
    """Mean over log time of the power law fitted to each group's mean curve on its bins (bin_s, value) between lower
    and upper, with an interval from refitting resampled clusters. A fit needs five bins."""
    kinds = dict(bins.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", clusters long, window_mean double, low double, high double, successes long"
    span = np.log(upper / lower)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        index = pdf[cluster].astype(str)
        total, n = (pdf.pivot_table(index=index, columns="bin_s", values=c, aggfunc="sum").fillna(0).sort_index() for c in ("total", "n"))
        x, t, c = np.log(total.columns.to_numpy(float)), total.to_numpy(), n.to_numpy()

        def mean(rows: np.ndarray) -> float:
            k = c[rows].sum(0)
            y = np.divide(t[rows].sum(0), k, out=np.zeros(len(k)), where=k > 0)
            ok = y > 0
            if ok.sum() < 5:
                return float("nan")
            a, b = np.polyfit(x[ok], np.log(y[ok]), 1, w=np.sqrt(k[ok]))
            return float(np.exp(b) * (upper**a - lower**a) / (a * span)) if abs(a) > 1e-12 else float(np.exp(b))

        rng = np.random.default_rng(group_seed(seed, *key))
        got = np.array([mean(rng.integers(0, len(t), len(t))) for _ in range(iterations)]) if len(t) > 1 else np.array([])
        low, high = percentile_interval(got)
        return pd.DataFrame([[*key, len(t), mean(np.arange(len(t))), low, high, int(np.isfinite(got).sum())]], columns=[*keys, "clusters", "window_mean", "low", "high", "successes"])

    own = bins.where(F.col("bin_s").between(lower, upper))
    return cluster_sums(own, keys, cluster, "value", "bin_s").groupBy(*keys).applyInPandas(one, schema)


def empirical_dropout(points: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Remove floor(fraction * n) observed frames of each unit and site at random, without filling."""
    if not 0 <= fraction < 1:
        raise ValueError("fraction must be in [0, 1)")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        rng = np.random.default_rng(group_seed(seed, *key))
        return pdf.drop(pdf.index[rng.choice(len(pdf), int(np.floor(fraction * len(pdf))), replace=False)])

    return points.groupBy("unit_id", "site").applyInPandas(one, points.schema)
