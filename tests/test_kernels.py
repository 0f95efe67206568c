"""Small trajectories with known statistics."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import curves, dense, lags, points, schedules
from trackloom.plans import summaries

P = "unit_id string, site string, nd2_id string, movie_frames int, frame int, time_s double, x double, y double"
FR = "unit_id string, nd2_id string, crop_id string, hour double, frame int, movie_frames int, time_s double, x1 double, y1 double, x2 double, y2 double"


def pts(spark, times, xs, ys=None, site="site1", movie=None, unit="u"):
    rows = [(unit, site, "n", movie or 4 * len(times), i + 1, float(t), float(x), float(y)) for i, (t, x, y) in enumerate(zip(times, xs, ys or [0.0] * len(xs))) if x is not None]
    return spark.createDataFrame(rows, P)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_missing_middle_and_jitter(spark):
    got = by(lags.mean_squared_displacement(pts(spark, range(5), [0, None, 2, 3, 4], movie=8), 1), "lag")
    assert {k: (r.pair_count, r.value) for k, r in got.items()} == {1: (2, 1.0), 2: (2, 4.0)}
    got = by(lags.mean_squared_displacement(pts(spark, [0, 1.01, 2, 3.02, 4], range(5), movie=8), 1), "lag")
    assert [(got[k].pair_count, got[k].value) for k in (1, 2)] == [(4, 1.0), (3, 4.0)]
    assert [round(got[1][c], 6) for c in ("lag_s_median", "lag_s_min", "lag_s_max")] == [1.0, 0.98, 1.02] and round(got[2].lag_s_max, 6) == 2.01


def test_counts_stay_below_min_pairs(spark):
    got = by(lags.mean_squared_displacement(pts(spark, range(5), range(5), movie=8), 4), "lag")
    assert got[1].value == 1.0 and got[2].pair_count == 3 and got[2].value is None and got[2].sd is None


def test_exact_time_lags(spark):
    got = by(lags.exact_time_msd(pts(spark, [0, 1, 3, 4], [0, 1, 3, 4]), [1.0, 2.0], 1e-9, 1), "lag_s")
    assert {k: (r.pair_count, r.value) for k, r in got.items()} == {1.0: (2, 1.0), 2.0: (1, 4.0)}
    epoch = pts(spark, [1e12 + t for t in (0, 0.1, 0.2, 0.3)], range(4))
    got = by(lags.exact_time_msd(epoch, [0.1, 0.101], 2e-4, 1), "lag_s")
    assert got[0.1].pair_count == 3 and 0.101 not in got
    with pytest.raises(lags.ExactTimeSupportError):
        lags.require_support(lags.exact_time_msd(epoch, [7.0], 1e-4, 1), 1)


def test_velocities_across_a_gap(spark):
    v = lags.velocities(pts(spark, [0, 1.1, 2, 3.2, 4], [0, None, 2, 3.2, 4], movie=20), [1])
    assert sorted(r.start_frame for r in v.collect()) == [3, 4]
    got = by(lags.velocity_autocorrelation(lags.velocities(pts(spark, [0, 1.1, 2, 3.2, 4], [0, 1.1, None, 3.2, 4], movie=20), [1]), 1), "lag")
    assert {k: got[k].pair_count for k in got} == {0: 2, 3: 1}


def test_cross_correlation_keeps_each_sites_own_support(spark):
    one = pts(spark, range(6), [None, 0, 100, None, 0, 1], movie=24)
    two = pts(spark, range(6), [0, 100, None, None, 0, 1], site="site2", movie=24)
    got = lags.velocity_cross_correlation(lags.velocities(one.union(two), [1]), 1).where("direction = 'site1_later_vs_site2'")
    rows = by(got, "lag")
    assert (rows[0].pair_count, rows[0].raw_value, rows[1].pair_count, rows[1].raw_value) == (1, 1.0, 1, 10000.0)
    assert rows[0].normalization == 5000.5 and rows[0].raw_value == rows[0].xx + rows[0].yy and rows[1].secondary_value == 1.0


def test_symmetrising_transposes_the_reverse(spark):
    rows = [("u", "site1_later_vs_site2", 1, 1, "x", "y", 2.0, 5), ("u", "site2_later_vs_site1", 1, 1, "y", "x", 4.0, 3), ("u", "site1_later_vs_site2", 1, 1, "x", "x", 9.0, 5)]
    df = spark.createDataFrame(rows, "unit_id string, direction string, delta int, lag int, row_component string, column_component string, raw_value double, pair_count long")
    got = lags.symmetrise(lags.transpose_reverse(df), ["unit_id", "row_component", "column_component"], ["raw_value"]).collect()
    assert [(r.row_component, r.column_component, r.raw_value, r.pair_count) for r in got] == [("x", "y", 3.0, 3)]


def test_curve_areas(spark):
    def area(counts, **kw):
        df = spark.createDataFrame([("u", i, float(i), v, c) for i, (v, c) in enumerate(zip([0.0, 2.0, -2.0, 2.0], counts))], "unit_id string, lag int, lag_s_median double, value double, pair_count long")
        return lags.integrate_curve(df, ["unit_id"], 8, 2.0, **kw).first()

    bad = area([10, 1, 10, 10])
    assert bad.reason == "insufficient_supported_duration" and bad.duration == 1.0 and bad.area is None
    assert area([10] * 4, positive_only=True).area == 2.0
    assert area([1] * 4).reason == "fewer_than_two_supported_lags" and area([10, 1, 10, 1]).reason == "no_adjacent_supported_lags"


def test_turns_and_bursts(spark):
    t = [0, 1.1, 2, 3.2, 4]
    turns = lags.turning_angles(lags.velocities(pts(spark, t, t, [2 * x for x in t]), [1])).collect()
    assert sorted(r.vertex for r in turns) == [2, 3, 4] and all(abs(r.angle) < 1e-6 for r in turns)
    assert sorted(round(r.to_s - r.from_s, 6) for r in turns) == [2.0, 2.0, 2.1]
    back = lags.turning_angles(lags.velocities(pts(spark, range(4), [0, 1, 0, 1]), [1]))
    assert all(r.angle == pytest.approx(math.pi) for r in back.collect())
    hist = by(lags.angle_histogram(back, ["unit_id"]), "bin")
    assert len(hist) == 18 and hist[17].n == 2 and hist[0].probability == 0.0
    assert lags.turning_persistence(back, ["unit_id"]).first().persistence == -1.0
    times = np.cumsum([0, 1, 1.1, 1, 1.1, 1, 1, 1, 1, 1, 1])
    runs = lags.directed_bursts(lags.turning_angles(lags.velocities(pts(spark, times, [x if i != 5 else None for i, x in enumerate(times)]), [1])), 30, 2, 1.0)
    assert sorted((r.first_frame, r.last_frame) for r in runs.collect()) == [(1, 5), (7, 11)]


def frames(spark, rows):
    return spark.createDataFrame(rows, FR)


def test_unit_builder(spark):
    line = [("complete", "n", "c", 1.0, i, 40, float(i), float(i), 0.0, float(i), 0.0) for i in range(1, 41)]
    gap = [("gap", "n", "c", 1.0, i, 40, float(i), float(i), 0.0, None, None) for i in range(1, 41) if i != 2]
    df = frames(spark, line + gap)
    clock = df.where("unit_id = 'complete'").select("nd2_id", "frame", "time_s")
    assert [(r.target_s, r.delta) for r in schedules.matched_delta(clock).collect()] == [(10.0, 10)]
    family = {r.delta: (r.role, r.is_primary) for r in schedules.delta_family(schedules.matched_delta(clock)).collect()}
    assert family == {**{d: ("paper_family", False) for d in (1, 2, 4, 8)}, 10: ("primary_matched_10s", True)}
    fast = {r.delta: (r.role, r.is_primary) for r in schedules.delta_family(schedules.matched_delta(clock.selectExpr("nd2_id", "frame", "time_s * 5 as time_s"))).collect()}
    assert fast[2] == ("paper_family", True) and len(fast) == 4
    msd = by(lags.mean_squared_displacement(points.site_points(df)), "unit_id", "site", "lag")
    assert (msd["gap", "site1", 1].pair_count, msd["gap", "site1", 1].value, msd["gap", "site1", 1].lag_s_median) == (37, 1.0, 1.0)
    curves = schedules.unit_curves(df, clock)
    assert curves.where("metric = 'vcc' and unit_id = 'gap'").isEmpty() and curves.where("metric = 'mscd' and value <> 0").isEmpty()
    census = by(schedules.support_census(df, curves), "unit_id", "metric", "site")
    assert census["gap", "mscd", "pair"].reason == "no_observations" and census["complete", "msd", "site2"].included
    matrix = lags.matrix_rows(lags.velocity_cross_correlation(lags.velocities(points.site_points(df.where("unit_id = 'complete'")), [1])))
    assert matrix.where("lag = 0").count() == 8


def test_pair_modes_and_energy(spark):
    df = frames(spark, [("u", "n", "c", 1.0, 1, 9, 0.0, 0.0, 0.0, 3.0, 4.0), ("u", "n", "c", 1.0, 2, 9, 1.0, None, 0.0, 3.0, 4.0)])
    a, b = points.pair_modes(df).orderBy("frame").collect()
    assert (a.separation, a.common_x, a.common_y) == (5.0, 1.5, 2.0) and b.separation is None and not b.valid
    e = points.motion_energy(df).orderBy("frame").first()
    assert e.total_energy == 25.0 and e.identity_residual == 0.0 and e.coherent_fraction == 0.5


def test_empty_tables(spark):
    none = pts(spark, [], [])
    assert lags.mean_squared_displacement(none).count() == 0 and lags.turning_angles(lags.velocities(none)).count() == 0


def test_dense_arrays_give_the_curves_of_the_joins(spark, data):
    own = points.bundle_frames(spark.read.parquet(f"{data}/frame_table.parquet"), spark.read.parquet(f"{data}/acquisition_index.parquet")).persist()
    clock = points.acquisition_clock(spark.read.parquet(f"{data}/frame_table.parquet"))
    keys = ["metric", "unit_id", "site", "direction", "delta", "lag"]
    a, b = (by(f(own, clock), *keys) for f in (schedules.unit_curves, schedules.unit_curves_by_joins))
    assert a.keys() == b.keys() and len(a) > 5000 and {k[0] for k in a} == {"msd", "mscd", "vac", "vcc"}
    for k in a:
        for c in ("value", "raw_value", "sd", "lag_s_median", "delta_s_median", "normalization"):
            assert (a[k][c] is None) == (b[k][c] is None) and (a[k][c] is None or a[k][c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-12)), (k, c)
        assert (a[k].pair_count, a[k].is_primary, a[k].hour, a[k].nd2_id) == (b[k].pair_count, b[k].is_primary, b[k].hour, b[k].nd2_id)


@pytest.mark.parametrize("channels", [["site1", "site2"], ["pair"]])
def test_dense_displacements_equal_the_pair_joins(spark, channels):
    rng = np.random.default_rng(8)
    rows = []
    for u in range(5):
        xy = rng.normal(size=(40, 4)).cumsum(0)
        for f in range(1, 41):
            x = [float(v) if rng.random() > 0.3 else None for v in xy[f - 1]]
            x[1], x[3] = (x[1] if x[0] is not None else None), (x[3] if x[2] is not None else None)
            x[0], x[2] = (x[0] if x[1] is not None else None), (x[2] if x[3] is not None else None)
            if u or f > 3:
                rows.append((f"u{u}", "n", "c", 1.0, f, 40, f * 0.5 + float(rng.random()) * 0.1, *x))
    rows.append(("empty", "n", "c", 1.0, 1, 40, 0.5, None, None, None, None))
    frames = spark.createDataFrame(rows, "unit_id string, nd2_id string, crop_id string, hour double, frame int, movie_frames int, time_s double, x1 double, y1 double, x2 double, y2 double")
    source = points.paired_points(frames) if channels == ["pair"] else points.site_points(frames)
    columns = ["unit_id", "site", "lag", "pair_count", "value", "sd", "lag_s_mean", "lag_s_median", "lag_s_min", "lag_s_max"]
    want, got = ({tuple(r[:3]): tuple(r[3:]) for r in df.select(*columns).collect()} for df in (lags.mean_squared_displacement(source), dense.displacements(frames, channels)))
    assert want.keys() == got.keys() and len(want) > 30
    for k, w in want.items():
        assert got[k] == pytest.approx(w, nan_ok=True), k
    assert dense.displacements(frames.where("false")).collect() == []


def test_symmetric_cross_correlation_equals_the_pair_joins(spark):
    """Holes, repeated times, several movie lengths and offset families, ties between lags, a unit of two acquisitions."""
    rng = np.random.default_rng(11)
    movies, rows = {"n1": 40, "n2": 90, "n3": 25}, []
    for u in range(12):
        own = ["n1", "n2", "n3"][u % 3]
        xy = rng.normal(size=(90, 4)).cumsum(0)
        for f in range(1, movies[own] + 1):
            x = [float(v) for v in xy[f - 1]]
            for s in (0, 2):
                if rng.random() < (0.75 if u == 4 else 0.2):
                    x[s : s + 2] = None, None
            nd2 = "n2" if u == 0 and f > 20 else "n3" if u == 1 and f <= 25 else own
            time = f * 0.5 if u != 5 or f % 7 else 0.5 * (f - 3)
            rows.append((f"u{u}", nd2, "c", 1.0, f, movies[nd2], time + float(rng.random()) * 0.1, *x))
    frames = spark.createDataFrame(rows, "unit_id string, nd2_id string, crop_id string, hour double, frame int, movie_frames int, time_s double, x1 double, y1 double, x2 double, y2 double").persist()
    deltas = spark.createDataFrame([("n1", 2), ("n1", 10), ("n2", 10), ("n2", 36), ("n3", 80)], "nd2_id string, delta int")
    centers = [0.25 * i for i in range(11)]
    last = F.least(F.col("movie_frames") - 1, F.floor(2.5 * F.col("delta") + 1e-12)).cast("int")
    cross = lags.velocity_cross_correlation(lags.velocities(points.site_points(frames), deltas), last=last).where("value is not null")
    both = lags.symmetrise(cross, ["unit_id", "delta", "lag"], ["value", "delta_s_median"]).withColumns({"lag_frames": F.col("lag"), "scaled_lag_tau_over_delta": F.col("lag") / F.col("delta")})
    want = by(curves.scaled_bins(both, centers, ["unit_id", "delta"]), "unit_id", "delta", "center")
    got = by(dense.symmetric_cross_correlation(frames, deltas, centers), "unit_id", "delta", "center")
    assert want.keys() == got.keys() and len(want) > 80 and {k[:2] for k in want} >= {("u0", 2), ("u1", 10), ("u1", 36)}
    for k, w in want.items():
        assert (got[k].lag, got[k].pair_count) == (w.lag, w.pair_count) and (got[k].value, got[k].delta_s_median) == pytest.approx((w.value, w.delta_s_median), rel=1e-9, abs=1e-12), k
    assert dense.symmetric_cross_correlation(frames.where("false"), deltas, centers).collect() == []
    assert dense.symmetric_cross_correlation(frames.where("frame = 1"), deltas, centers).collect() == []


def test_hour_curves_and_tau_build_no_pairs_of_frames(spark, data, monkeypatch):
    """The correlations over long lags come from the frames, and still equal their SQL."""
    monkeypatch.setattr(lags, "_pairs", lambda *a: pytest.fail("a row for every pair of frames"))
    assert summaries.f_tau_grid(spark, data).count() > 0
    con = duckdb.connect()
    for name in ("frame_table", "acquisition_index"):
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    result = con.execute(summaries.ORACLES["a_vcc_hour_curves"])
    names, keys = [d[0] for d in result.description], ("hour_post_delivery", "target_s", "center")
    want = {tuple(r[names.index(k)] for k in keys): dict(zip(names, r)) for r in result.fetchall()}
    got = {tuple(r[k] for k in keys): r.asDict() for r in summaries.a_vcc_hour_curves(spark, data).collect()}
    assert want.keys() == got.keys() and len(want) > 100
    for k, w in want.items():
        for c, v in w.items():
            assert got[k][c] == pytest.approx(v, nan_ok=True), (k, c)


def test_each_unit_has_its_own_tolerance(spark):
    """A unit at a late epoch gets the rounding of its large times; the others stay exact."""
    rows = [("late", "site1", f, 1e9 + f * 0.1, float(f), 0.0) for f in range(1, 12)] + [("early", "site1", f, f * 0.1 + (1e-8 if f == 5 else 0.0), float(f), 0.0) for f in range(1, 12)]
    p = lags.with_tolerance(spark.createDataFrame(rows, "unit_id string, site string, frame int, time_s double, x double, y double"), 0.1)
    size = {r.unit_id: r.tolerance for r in p.select("unit_id", "tolerance").distinct().collect()}
    assert size["late"] > 1e-7 and size["early"] < 1e-12
    got = lags.exact_time_pairs(p, [0.1], "tolerance").groupBy("unit_id").count().collect()
    assert {r.unit_id: r["count"] for r in got} == {"late": 10, "early": 8}
