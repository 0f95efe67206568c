"""Numeric lookup cube (exponent, log10 of delta / tau, scaled lag) and the search for the communication time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cube:
    """A reference function on a regular grid; its size is the grid's, not the data's."""

    alphas: np.ndarray
    log_ratios: np.ndarray
    lags: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        if self.values.shape != (len(self.alphas), len(self.log_ratios), len(self.lags)) or not np.isfinite(self.values).all():
            raise ValueError("the cube must be finite and fit its axes")

    def evaluate(self, alpha, log_ratio, lag) -> np.ndarray:
        """Trilinear interpolation; a point outside the cube is an error."""
        at = np.broadcast_arrays(*(np.asarray(x, float) for x in (alpha, log_ratio, lag)))
        low, part = [], []
        for x, axis in zip(at, (self.alphas, self.log_ratios, self.lags)):
            if ((x < axis[0]) | (x > axis[-1])).any():
                raise ValueError("outside the cube")
            i = np.clip(np.searchsorted(axis, x, side="right") - 1, 0, len(axis) - 2)
            low.append(i)
            part.append((x - axis[i]) / (axis[i + 1] - axis[i]))
        out = np.zeros(at[0].shape)
        for corner in np.ndindex(2, 2, 2):
            weight = np.prod([p if c else 1 - p for c, p in zip(corner, part)], axis=0)
            out += weight * self.values[tuple(i + c for i, c in zip(low, corner))]
        return out


TAU_FIT = "targets long, points long, tau_s double, mse double, rmse double, r_squared double, boundary boolean"


def _best_tau(pdf: pd.DataFrame, cube: Cube, alpha: float, taus: tuple[int, int]) -> dict:
    """First best tau with its fit; NaN where support is too small. The cube's ratio axis is delta / tau."""
    pdf = pdf.groupby("target_s").filter(lambda g: len(g) >= 3)
    targets = pdf.target_s.to_numpy()
    kinds = np.unique(targets)
    out = {"targets": len(kinds), "points": len(pdf), "tau_s": np.nan, "mse": np.nan, "rmse": np.nan, "r_squared": np.nan, "boundary": None}
    if len(kinds) < 2 or len(pdf) < 6:
        return out
    tau, seen = np.arange(taus[0], taus[1] + 1), pdf.value.to_numpy()
    shape = cube.evaluate(alpha, np.log10(pdf.delta_s.to_numpy()[None, :] / tau[:, None]), pdf.center.to_numpy()[None, :])
    error = (seen[None, :] - shape) ** 2
    loss = np.mean([error[:, targets == t].mean(1) for t in kinds], axis=0)
    best = int(loss.argmin())
    spread = float(((seen - seen.mean()) ** 2).sum())
    fit = {"tau_s": float(tau[best]), "mse": float(loss[best]), "rmse": float(np.sqrt(loss[best])), "boundary": best in (0, len(tau) - 1)}
    return out | fit | {"r_squared": 1 - float(error[best].sum()) / spread if spread > 0 else np.nan}


def tau_search(points: DataFrame, cube: Cube, alpha: float, taus: tuple[int, int] = (1, 1000), least_units: int = 8, last_lag: float = 2.5) -> DataFrame:
    """Communication time per hour: the first tau on the whole-second grid that minimises the mean over targets
    of the mean squared error against cube(alpha, log10(delta / tau), lag); boundary tells a tau at either end of
    the grid. points: hour_post_delivery, target_s, center, value, delta_s, units; bins of fewer units are left out,
    a target needs three bins, an hour two targets and six points; a tau whose ratio lies outside the cube is an
    error. An hour has at most targets x centers points, so it is one group."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"hour_post_delivery": key[0], **_best_tau(pdf, cube, alpha, taus)}])

    use = points.where((F.col("units") >= least_units) & F.col("center").between(0, last_lag) & F.col("value").isNotNull())
    return use.groupBy("hour_post_delivery").applyInPandas(one, f"hour_post_delivery double, {TAU_FIT}")


def tau_bootstrap(units: DataFrame, cube: Cube, alpha: float, cluster: str, iterations: int = 200, seed: int = 0, least_units: int = 8) -> DataFrame:
    """tau_search with an interval from resampling clusters. units: one point per unit, target and center
    (hour_post_delivery, target_s, center, value, delta_s, the cluster); Spark sums them by cluster and bin first, so
    that a group in pandas holds clusters x bins rows. A cluster drawn twice counts its units twice."""
    from trackloom.operators.resampling import group_seed, percentile_interval

    sums = units.where("value is not null").groupBy("hour_post_delivery", cluster, "target_s", "center").agg(F.sum("value").alias("total"), F.sum("delta_s").alias("delta"), F.count(F.lit(1)).alias("n"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        index = [pdf[cluster].astype(str), "target_s", "center"]
        wide = {c: pdf.groupby(index)[c].sum().unstack([1, 2], fill_value=0.0).sort_index() for c in ("total", "delta", "n")}
        bins, sizes = wide["n"].columns, {c: w.to_numpy(float) for c, w in wide.items()}

        def tau(drawn: np.ndarray) -> float:
            total, delta, n = (drawn @ sizes[c] for c in ("total", "delta", "n"))
            ok = n >= least_units
            table = pd.DataFrame({"target_s": bins.get_level_values(0)[ok], "center": bins.get_level_values(1)[ok], "value": total[ok] / n[ok], "delta_s": delta[ok] / n[ok]})
            return _best_tau(table, cube, alpha, (1, 1000))["tau_s"] if len(table) else np.nan

        count = len(sizes["n"])
        rng = np.random.default_rng(group_seed(seed, *key))
        got = np.array([tau(np.bincount(rng.integers(0, count, count), minlength=count)) for _ in range(iterations)]) if count > 1 else np.array([])
        low, high = percentile_interval(got)
        return pd.DataFrame([{"hour_post_delivery": key[0], "clusters": count, "tau_s": tau(np.ones(count)), "low": low, "high": high}])

    return sums.groupBy("hour_post_delivery").applyInPandas(one, "hour_post_delivery double, clusters long, tau_s double, low double, high double")
