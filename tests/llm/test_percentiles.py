import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from trackloom.llm import percentiles as module
from trackloom.llm import queries
from trackloom.llm.percentiles import combine, midpoint, percentiles, summarise

PS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def check(spark, rows, ps=PS):
    df = spark.createDataFrame(rows, "g string, h double, v double, rank string, goal int")
    got = {(r.g, r.h, r.p): (r.n, r.percentile) for r in percentiles(summarise(df, "v", ["g", "h"]), ["g", "h"], ps).collect()}
    want = {}
    for g, h in {(r[0], r[1]) for r in rows}:
        v = [r[2] for r in rows if (r[0], r[1]) == (g, h) and r[2] is not None and not math.isnan(r[2])]
        for p in ps if v else []:
            want[g, h, p] = (len(v), float(np.quantile(v, p)))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-12, abs_tol=1e-300), (k, got[k], want[k])


def test_groups_ties_nulls_and_sizes(spark):
    rng = np.random.default_rng(1)
    rows = [("a", 1.0, float(v), "", 0) for v in rng.lognormal(0, 12, 300)] + [("a", None, float(v), "", 0) for v in rng.integers(-3, 3, 200)]
    rows += [(None, 2.0, 7.0, "", 0)] * 5 + [("b", 1.0, None, "", 0), ("b", 1.0, float("nan"), "", 0), ("c", 1.0, -0.0, "", 0), ("c", 1.0, 1e-300, "", 0), ("c", 1.0, -1e300, "", 0), ("c", 1.0, 5e-324, "", 0)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300), min_size=1, max_size=40))
def test_any_values(spark, values):
    check(spark, [("a", 1.0, v, "", 0) for v in values], [0.0, 0.5, 1.0])


def test_infinite_values_sort_at_the_ends(spark):
    df = spark.createDataFrame([("a", v) for v in (float("-inf"), 1.0, 2.0, float("inf"), float("inf"))], "g string, v double")
    got = {r.p: r.percentile for r in percentiles(summarise(df, "v", ["g"]), ["g"], [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: float("-inf"), 0.5: 2.0, 1.0: float("inf")}


def test_summaries_of_parts_combine(spark):
    rows = [("a", f"day{i % 3}", float(i % 17) * 1.37) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, day string, v double")
    parts = [summarise(df.where(f"day = 'day{i}'"), "v", ["g"]) for i in range(3)]
    whole = {tuple(r) for r in summarise(df, "v", ["g"]).select("g", "x", "n").collect()}
    assert {tuple(r) for r in combine(*parts, groups=["g"]).select("g", "x", "n").collect()} == whole
    assert {tuple(r) for r in combine(summarise(df, "v", ["g", "day"]), groups=["g"]).select("g", "x", "n").collect()} == whole
    a = percentiles(summarise(df, "v", ["g"]), ["g"], PS).collect()
    b = percentiles(combine(*parts, groups=["g"]), ["g"], PS).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_small_groups_take_the_other_join(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT_SHARE", 3)
    rng = np.random.default_rng(4)
    rows = [("big", 1.0, float(v), "", 0) for v in rng.normal(size=500)] + [(None if i % 7 == 0 else f"g{i % 7}", None, float(v), "", 0) for i, v in enumerate(rng.lognormal(0, 3, 150))]
    check(spark, rows)


def test_error_bound_holds(spark):
    rng = np.random.default_rng(5)
    v = rng.lognormal(0, 5, 400)
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    ranks = [k / 399 for k in (0, 100, 200, 399)]
    for r in percentiles(summarise(df, "v", ["g"]), ["g"], ranks, error=0.01).collect():
        true = float(np.quantile(v, r.p))
        assert abs(r.percentile - true) <= r.error * 1.001 + 1e-9 * true and r.error <= 0.0051 * max(true, r.percentile)


def test_midpoints_lie_inside(spark):
    ends = [float("-inf"), -1.7976931348623157e308, -1e300, -4.0, -1.0, -np.nextafter(1, 0), -5e-324, 0.0, 5e-324, 1e-323, 1e-300, 1.0, np.nextafter(1, 2), 4.1, 1e300, 1.7976931348623157e308, float("inf")]
    pairs = spark.createDataFrame([(float(a), float(b)) for i, a in enumerate(ends) for b in ends[i + 1 :]], "lo double, hi double")
    assert pairs.where(~((midpoint(F.col("lo"), F.col("hi")) >= F.col("lo")) & (midpoint(F.col("lo"), F.col("hi")) < F.col("hi")))).count() == 0


def test_query_against_sql(spark, data):
    import duckdb

    got = queries.p3_percentiles(spark, data).toPandas()
    for t in ("frame_table", "unit_curves"):
        duckdb.sql(f"create or replace view {t} as select * from '{data}/{t}.parquet'")
    want = duckdb.sql(queries.P3_SQL).df()
    key = ["scope", "measure", "group_a", "group_b", "part", "p"]
    both = got.fillna({"group_b": "", "group_a": "", "part": ""}).merge(want.fillna({"group_b": "", "group_a": "", "part": ""}), on=key, how="outer", indicator=True)
    assert (both._merge == "both").all() and (both.n_x == both.n_y).all() and np.allclose(both.percentile_x, both.percentile_y, rtol=1e-9, atol=1e-9)
