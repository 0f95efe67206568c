"""Percentiles of very large columns by exact bisection, from summaries that add up.

A summary counts each distinct value of a group: (groups, x, n), made with map-side combine. Summaries of
parts (files, days, acquisitions) add up to the summary of the whole. Bisection keeps an interval of values
per group and percentile. Each pass counts the rows below the midpoints of all open intervals and keeps the
half that holds the target rank, shrunk to its smallest and largest value, until one value is left (or the
interval is as narrow as the error allows).

Midpoints are geometric while the ends differ much in size and arithmetic after that: at most 12 passes bring
two doubles within a factor of 4 and 54 more to the same value, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trackloom.session import written

HOT_SHARE = 10_000  # groups with more than this part of the summary are few enough to broadcast
_LARGEST, _SMALLEST = 1.7976931348623157e308, 5e-324


def summarise(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """(groups, x, n): how often each non-missing value occurs in a group. Null and NaN are missing."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, v.alias("x")).agg(F.count(F.lit(1)).alias("n"))


def combine(*summaries: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add up summaries of parts, keeping the columns `groups`: other group columns are merged away."""
    every = reduce(DataFrame.unionByName, [s.select(*groups, "x", "n") for s in summaries])
    return every.groupBy(*groups, "x").agg(F.sum("n").alias("n"))


def midpoint(lo: Column, hi: Column) -> Column:
    """A number m with lo <= m < hi, for lo < hi."""
    size = F.sqrt(F.abs(lo)) * F.sqrt(F.abs(hi))
    mid = (
        F.when(lo == float("-inf"), lo)
        .when(hi == float("inf"), F.lit(_LARGEST))
        .when((lo < 0) & (hi > 0), F.lit(0.0))
        .when(hi == 0, F.lit(-_SMALLEST))
        .when(lo == 0, lo)
        .when((lo > 0) & (hi / 4 > lo), size)
        .when((hi < 0) & (lo / 4 < hi), -size)
        .otherwise(lo / 2 + hi / 2)
    )
    return F.when((mid >= lo) & (mid < hi), mid).otherwise(lo)


def _pass(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Split every open interval at its midpoint: count the rows at or below it, and give each half that holds a
    target rank its ends (values that occur), its rows and its targets. One shuffle, of one row per interval and task."""
    x, n = F.col("x"), F.col("n")
    cuts = open_.select("*", midpoint(F.col("lo"), F.col("hi")).alias("mid")).withColumnRenamed("_id", "_own")
    here = rows.join(cuts, (F.col("_id") == F.col("_own")) & (x >= F.col("lo")) & (x <= F.col("hi")))
    low = x <= F.col("mid")
    carried = [F.first(c).alias(c) for c in ("hot", "hi", "inside", "below", "beyond", "goals")]
    split = here.groupBy("_id", "lo").agg(
        F.sum(F.when(low, n)).alias("n_low"), F.max(F.when(low, x)).alias("top"), F.min(F.when(~low, x)).alias("next"), *carried
    )
    upto = F.col("below") + F.col("n_low")

    def half(lo: Column, hi: Column, inside: Column, below: Column, beyond: Column, goals: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), inside.alias("inside"), below.alias("below"), beyond.alias("beyond"), goals.alias("goals"))

    halves = F.array(
        half(F.col("lo"), F.col("top"), F.col("n_low"), F.col("below"), F.col("next"), F.filter("goals", lambda g: g["rank"] < upto)),
        half(F.col("next"), F.col("hi"), F.col("inside") - F.col("n_low"), upto, F.col("beyond"), F.filter("goals", lambda g: g["rank"] >= upto)),
    )
    return split.select("_id", "hot", F.inline(F.filter(halves, lambda h: F.size(h["goals"]) > 0)))


def percentiles(summary: DataFrame, groups: Sequence[str], ps: Sequence[float], error: float = 0.0) -> DataFrame:
    """(groups, p, n, percentile, error): percentiles of each group of a summary (groups, x, n), with linear
    interpolation between ranks; n is the number of values.

    With error 0 the values are exact; else the value at a rank is off by at most the column `error`, which is at
    most half of `error` times the value's size. (groups, x) must be unique, as combine makes it. Groups without values
    give no row; null group keys form a group of their own; ties and repeated rows count as often as they occur;
    an empty summary gives an empty result. Infinite values sort at the ends, and an interpolation in which one
    takes part gives it. Other columns are ignored; groups may have any names but x, n, p, percentile and error.

    Every row meets the at most len(ps) intervals of its group. The intervals of groups with more than a
    1 / HOT_SHARE part of the summary (fewer than HOT_SHARE groups) are broadcast, so their rows stay where they are
    however many there are; the rows of the others, each a small part, meet theirs by merge joins.
    """
    keyed = written(summary.select(F.struct(*[F.col(g) for g in groups]).alias("_key"), F.col("x").cast("double").alias("x"), "n"))
    totals = keyed.groupBy("_key").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cells"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    totals = written(totals.withColumn("_id", F.monotonically_increasing_id()))
    cells = totals.agg(F.sum("cells")).first()[0]
    totals = totals.withColumn("hot", F.col("cells") * HOT_SHARE > F.lit(cells or 0))
    hot = totals.where("hot").select("_key", "_id")
    rows = {True: written(keyed.join(F.broadcast(hot), "_key").select("_id", "x", "n"))}
    if not totals.where("not hot").isEmpty():
        cold = totals.where("not hot").select("_key", "_id").hint("merge")
        rows[False] = written(keyed.join(F.broadcast(hot), "_key", "left_anti").join(cold, "_key").select("_id", "x", "n"))

    goals = [F.struct(F.lit(float(p)).alias("p"), F.floor(F.lit(float(p)) * (F.col("rows") - 1)).cast("long").alias("rank")) for p in ps]
    state = totals.select(
        "_id", "hot", "lo", "hi", F.col("rows").alias("inside"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("beyond"), F.array(*goals).alias("goals")
    )
    narrow = F.col("lo") == F.col("hi")
    if error > 0:
        size = F.greatest(F.abs("lo"), F.abs("hi"))
        narrow = narrow | ((size < float("inf")) & (F.col("hi") - F.col("lo") <= error * size))
    resolved = []
    while True:
        seen = Observation()
        state = written(state.observe(seen, F.count_if(~narrow & F.col("hot")).alias("hot"), F.count_if(~narrow & ~F.col("hot")).alias("cold")))
        resolved.append(state.where(narrow))
        sides = []
        if seen.get.get("hot"):
            sides.append(_pass(rows[True], F.broadcast(state.where(~narrow & F.col("hot")))))
        if seen.get.get("cold"):
            sides.append(_pass(rows[False], state.where(~narrow & ~F.col("hot")).hint("merge")))
        if not sides:
            break
        state = reduce(DataFrame.unionByName, sides)
    found = reduce(DataFrame.unionByName, resolved).select("*", F.inline("goals")).join(totals.select("_id", "_key", "rows"), "_id")
    fraction = F.col("p") * (F.col("rows") - 1) - F.col("rank")
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") / 2 + F.col("hi") / 2)
    after = F.when(F.col("rank") + 1 < F.col("below") + F.col("inside"), value).otherwise(F.col("beyond"))
    between = F.when((fraction == 0) | (value == after), value).otherwise(value * (1 - fraction) + after * fraction)
    off = F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise(F.col("hi") / 2 - F.col("lo") / 2)
    return found.select(*[F.col("_key")[g].alias(g) for g in groups], "p", F.col("rows").alias("n"), between.alias("percentile"), off.alias("error"))
