"""Scalar column functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before rounding, so that exact decimal ties do not depend on an engine's rounding rule.
TIE = 1.37e-11


#: From here on a double's last digits depend on the order of a sum, so numbers are rounded to single precision.
LARGE = 1e7


def rounded(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c).between(LARGE, 1e30), c.cast("float").cast("double")).otherwise(F.round(c + F.lit(TIE), digits))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def fbm_vac(x: Column, alpha: Column | float) -> Column:
    """Velocity autocorrelation of fractional Brownian motion, normalised, at scaled lag x."""
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return (F.pow(F.abs(x - 1), a) + F.pow(F.abs(x + 1), a) - 2 * F.pow(F.abs(x), a)) / 2


def bin_edges(centers: Sequence[float]) -> list[float]:
    """Geometric midpoints between centers; the outer edges mirror their neighbours."""
    inner = [math.sqrt(a * b) for a, b in zip(centers, centers[1:])]
    return [centers[0] ** 2 / inner[0], *inner, centers[-1] ** 2 / inner[-1]]


def lag_bin(lag: Column, centers: Sequence[float]) -> Column:
    """Center of the half-open bin that holds the lag; 0 for zero lag, null outside."""
    edges = bin_edges(centers)
    out = F.when(F.abs(lag) <= 1e-12, F.lit(0.0))
    for c, low, high in zip(centers, edges, edges[1:]):
        out = out.when((lag >= low) & (lag < high), F.lit(float(c)))
    return out


def nearest_center(x: Column, centers: Sequence[float]) -> Column:
    """The center nearest to x; of equals the lower."""
    options = F.array(*[F.struct(F.abs(x - F.lit(float(c))).alias("d"), F.lit(float(c)).alias("c")) for c in centers])
    return F.array_min(options)["c"]


def flag(c: Column) -> Column:
    """Text or number as boolean: true/1/yes/y and false/0/no/n in any case; anything else is null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def bad_flag(c: Column) -> Column:
    """Present but no boolean."""
    return c.isNotNull() & flag(c).isNull()


def positive_area(a: Column, b: Column, width: Column) -> Column:
    """Area above zero under the straight line from a to b, with the exact crossing."""
    return (
        F.when((a >= 0) & (b >= 0), (a + b) * width / 2)
        .when((a <= 0) & (b <= 0), F.lit(0.0))
        .when(a > 0, a * width * a / (a - b) / 2)
        .otherwise(b * width * b / (b - a) / 2)
    )


def log_window_mean(amplitude: Column, alpha: Column, low: float, high: float) -> Column:
    """Mean of amplitude * t**alpha over log time between low and high."""
    span = math.log(high / low)
    return F.when(F.abs(alpha) < 1e-12, amplitude).otherwise(
        amplitude * (F.pow(F.lit(high), alpha) - F.pow(F.lit(low), alpha)) / (alpha * span)
    )
