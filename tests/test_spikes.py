import datetime as dt

import numpy as np
import pytest

from trackloom.operators.spikes import _out_of_order, implausible_readings

SCHEMA = "bundle_id string, frame long, acquisition_id string, loaded_at timestamp, x double, t double, kind string, limit double"
NOW = dt.datetime(2025, 1, 1)


def run(spark, series, limit=1000.0, times=None):
    rows = [("b", i + 1, "a", NOW, v, None if times is None else times[i], "clash", 1.0) for i, v in enumerate(series) if v != "absent"]
    return found(spark, rows, limit)


def found(spark, rows, limit=1000.0):
    df = spark.createDataFrame(rows, SCHEMA)
    lim = spark.createDataFrame([("a", limit)], "acquisition_id string, limit double")
    return sorted((r.frame, r.field, r.kind) for r in implausible_readings(df, lim, ["x"], "t").collect() if r.bundle_id is not None)


def walk(n=40):
    rng = np.random.default_rng(5)
    return (500 + np.cumsum(rng.choice([-1.0, 1.0, 1.5], n))).tolist()


def test_spike_returns_and_level_shift_stays(spark):
    s = walk()
    s[10] += 100
    assert run(spark, s) == [(11, "x", "spike")]
    s = walk()
    for i in range(10, 13):
        s[i] += 100
    assert [r[0] for r in run(spark, s)] == [11, 12, 13]
    s = walk()
    for i in range(10, 40):
        s[i] += 100
    assert run(spark, s) == [(11, "x", "level_shift")]


def test_gap_beside_the_spike_and_short_series(spark):
    s = walk()
    s[10] += 100
    s[11] = None
    assert all(k != "spike" for _, _, k in run(spark, s))
    s = walk()
    s[10] += 100
    s[11] = "absent"
    assert all(k != "spike" for _, _, k in run(spark, s))
    s = walk(19)
    s[10] += 100
    assert all(k != "spike" for _, _, k in run(spark, s))


def test_limits_stuck_and_missing(spark):
    s = walk()
    s[3], s[5], s[7], s[9] = -1.0, float("inf"), 2000.0, float("nan")
    s[20:24] = [s[20]] * 4
    got = run(spark, s)
    assert [(f, k) for f, _, k in got if k == "limit"] == [(4, "limit"), (6, "limit"), (8, "limit")]
    assert [f for f, _, k in got if k == "stuck"] == [22, 23, 24]
    assert run(spark, [5.0] * 3) == []
    assert [f for f, _, _ in run(spark, [5.0] * 4)] == [2, 3, 4]


def test_limit_unknown_empty_and_repeats(spark):
    s = walk()
    s[3] = 1e9
    assert (4, "x", "limit") not in run(spark, s, None)
    assert found(spark, []) == []
    rows = [("b", 1, "a", NOW, 1.0, 0.0, "", 0.0), ("b", 1, "a", NOW + dt.timedelta(1), -5.0, 0.0, "", 0.0), (None, 2, "a", NOW, -5.0, 1.0, "", 0.0), ("b", None, "a", NOW, -5.0, 1.0, "", 0.0)]
    assert found(spark, rows) == []


@pytest.mark.parametrize("times, out", [([0, 1, 2, 3], []), ([0, 5, 2, 3], [1]), ([0, 1, 1, 1, 2], [2, 3]), ([3, 2, 1], None), ([0, 1, -1, 2], [2])])
def test_times(times, out):
    got = np.flatnonzero(_out_of_order(np.array(times, float))).tolist()
    assert len(got) == len(times) - 1 if out is None else got == out


def test_times_in_the_operator(spark):
    got = run(spark, walk(6), times=[0.0, 1.0, 9.0, 2.0, -1.0, 3.0])
    assert got == [(3, "t", "time_order"), (5, "t", "limit")]


def test_longest_increasing_run_is_longest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        t = rng.integers(0, 8, rng.integers(1, 12)).astype(float)
        kept = t[~_out_of_order(t)]
        assert (np.diff(kept) > 0).all()
        best = np.ones(len(t), int)
        for i in range(len(t)):
            for j in range(i):
                if t[j] < t[i]:
                    best[i] = max(best[i], best[j] + 1)
        assert len(kept) == best.max()


def test_return_is_measured_by_the_runs_own_distance(spark):
    """A run 100 steps away that comes back to 10 steps from where it left is an outlier, not a shift."""
    s = walk()
    s[10] += 100
    for i in range(11, 40):
        s[i] += 10
    assert (11, "x", "spike") in run(spark, s)
    s = walk()
    s[10] += 100
    for i in range(11, 40):
        s[i] += 60
    assert [x for x in run(spark, s) if x[2] == "spike"] == []


def test_scores_separate_outliers_from_shifts(spark):
    s = walk(60)
    s[10] += 100
    for i in range(40, 60):
        s[i] += 100
    rows = [("b", i + 1, "a", NOW, v, None, "clash", 1.0) for i, v in enumerate(s)]
    lim = spark.createDataFrame([("a", 1000.0)], "acquisition_id string, limit double")
    got = {r.kind: r for r in implausible_readings(spark.createDataFrame(rows, SCHEMA), lim, ["x"], "t").collect()}
    assert got["spike"].frame == 11 and got["spike"].score > 12 and got["spike"].score_outlier < got["spike"].score_shift
    assert got["level_shift"].frame == 41 and got["level_shift"].score_shift < got["level_shift"].score_outlier


def test_every_run_of_the_rule_is_found(spark):
    """The autoregressive tests let every run pass that the exact rule confirms."""
    rng = np.random.default_rng(3)
    rows = []
    for b in range(60):
        x = 500 + np.cumsum(rng.normal(size=60) * rng.choice([1, 1, 1, 8], 60))
        for i in rng.integers(1, 57, 5):
            x[i : i + rng.integers(1, 4)] += rng.choice([-1, 1]) * rng.uniform(8, 60)
        rows += [(f"b{b}", i + 1, "a", NOW, float(v), None, "", 1.0) for i, v in enumerate(x) if rng.random() > 0.02]
    want = set()
    for b in {r[0] for r in rows}:
        own = [(r[1], r[4]) for r in rows if r[0] == b]
        f, x = np.array([o[0] for o in own]), np.array([o[1] for o in own])
        m = np.median(np.abs(np.diff(x)))
        for i in range(1, len(x)):
            for k in (1, 2, 3):
                if i + k < len(x) and (np.abs(x[i : i + k] - x[i - 1]) > 12 * m).all() and abs(x[i + k] - x[i - 1]) <= np.abs(x[i : i + k] - x[i - 1]).min() / 2 and f[i + k] - f[i - 1] == k + 1:
                    want |= {(b, int(v)) for v in f[i : i + k]}
    lim = spark.createDataFrame([("a", 1e9)], "acquisition_id string, limit double")
    got = {(r.bundle_id, r.frame) for r in implausible_readings(spark.createDataFrame(rows, SCHEMA), lim, ["x"], None).where("kind = 'spike'").collect()}
    assert len(want) > 100 and got == want
