import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as fn

from trackloom.operators import regular_grid as grid
from trackloom.operators.regular_grid import regular_grid

F = "group_id string, source_id string, time_s double, counts boolean, a_seen boolean, a_value double, state string"


def run(spark, rows, sources=("s", "s2"), clocks=(("g", 1.0, 4, 1e4),), **kw):
    frames = spark.createDataFrame([(*r, "clash") for r in rows], F)
    src = spark.createDataFrame([(x, 1) for x in sources], "source_id string, slot int")
    clk = spark.createDataFrame(list(clocks), "group_id string, period_s double, last_slot int, limit double")
    return {(r.bundle_id, r.slot): (r.state, r.x) for r in regular_grid(frames, src, clk, {"a": ["a_value"]}, **kw).collect()}


def test_slots_states_and_exact_values(spark):
    rows = [("g", "s", 0.0, True, True, 5.0), ("g", "s", 1.4, True, True, 7.0), ("g", "s", 2.5, True, False, None), ("g", "s", 9.0, True, True, 1.0), ("g", "s", None, True, True, 1.0), ("g", "s", float("inf"), True, True, 1.0), ("g", "s", 4.0, True, True, None)]
    got = run(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {("s", 0): "observed", ("s", 1): "observed", ("s", 2): "unsupported", ("s", 3): "unsupported", ("s", 4): "observed"}
    assert got["s", 0][1] == 5.0 and got["s", 1][1] == 7.0 and got["s", 4][1] is None and got["s", 2][1] is None


def test_sources_without_mark_clock_or_place_are_left_out(spark):
    rows = [("g", "s", 0.0, False, True, 5.0), ("h", "s2", 0.0, True, True, 5.0), ("g", "x", 0.0, True, True, 5.0), (None, "s", 0.0, True, True, 1.0), ("g", None, 0.0, True, True, 1.0)]
    assert run(spark, rows) == {}
    assert run(spark, []) == {}
    assert run(spark, [("g", "s", 0.0, True, True, 5.0)], clocks=(("g", 0.0, 4, None), ("g2", None, 4, None))) == {}


def test_only_late_or_timeless_rows_still_make_a_source(spark):
    got = run(spark, [("g", "s", None, True, True, 5.0)])
    assert len(got) == 5 and {v[0] for v in got.values()} == {"unsupported"}


def test_low_rank_matrix_is_recovered(spark):
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(40, 2)), np.cumsum(rng.normal(size=(30, 2)), axis=0)
    m = 100 + u @ v.T + rng.normal(size=(40, 1)) * 10
    mask = rng.random(m.shape) < 0.75
    rows = [("g", f"s{i}", float(j), True, True, float(m[i, j])) for i in range(40) for j in range(30) if mask[i, j]]
    got = run(spark, rows, [f"s{i}" for i in range(40)], (("g", 1.0, 29, 1e4),), rounds=20, tolerance=1e-3)
    hidden = [(i, j) for i in range(40) for j in range(30) if not mask[i, j]]
    lines = [abs(np.interp(j, np.flatnonzero(mask[i]), m[i, mask[i]]) - m[i, j]) for i, j in hidden]
    err = [abs(got[f"s{i}", j][1] - m[i, j]) for i, j in hidden]
    assert all(got[f"s{i}", j][0] == "filled" for i, j in hidden)
    assert np.median(err) < np.median(lines)  # the sources share their time factors, which lines cannot see
    assert all(got[f"s{i}", j][1] == m[i, j] for i in range(40) for j in range(30) if mask[i, j])


@pytest.mark.parametrize("size", [0.0, 1.0, 1e9, 1e-9])
def test_systems_stay_regular(spark, size):
    """Constant, huge and tiny readings, a single source, and fewer sources than ranks."""
    rows = [("g", s, float(j), True, True, size * (1 + j % 3)) for s in "abcdef" for j in range(40) if j % 5]
    got = run(spark, rows, "abcdef", clocks=(("g", 1.0, 39, None),))
    assert len(got) == 240 and all(v[0] in ("observed", "filled") for v in got.values())
    assert all(abs(v[1]) <= 10 * size + 1e-12 for v in got.values())


def test_a_period_no_window_has_seen_is_unsupported(spark):
    rows = [("g", "s", float(j), True, True, 50.0 + j % 3) for j in range(60) if j % 12 != 5]
    got = run(spark, rows, clocks=(("g", 1.0, 59, None),))
    assert {got["s", j][0] for j in range(5, 60, 12)} == {"unsupported"}


def test_impossible_readings_stay_exact_and_out_of_the_fit(spark):
    clean = [("g", s, float(j), True, True, 50.0 + j % 2) for s in "sabcde" for j in range(30) if s != "s" or j != 7]
    dirty = [(*r[:5], 1e9 if r[1:3] == ("s", 11.0) else -4.0 if r[1:3] == ("s", 20.0) else r[5]) for r in clean]
    got = run(spark, dirty, "sabcde", clocks=(("g", 1.0, 29, 100.0),))
    assert got["s", 11] == ("observed", 1e9) and got["s", 20] == ("observed", -4.0)
    assert got["s", 7][0] == "filled" and 45 < got["s", 7][1] < 56


def test_a_gap_longer_than_a_window_is_unsupported(spark):
    rows = [("g", s, float(j), True, True, 50.0 + j % 2) for s in "sabcde" for j in [*range(20), *range(100, 120)]]
    got = run(spark, rows, "sabcde", clocks=(("g", 1.0, 119, None),))
    assert got["s", 60][0] == "unsupported" and got["s", 22][0] == "filled"


def test_held_out_cells_are_filled_as_well_as_by_lines(spark):
    """Every tenth frame of the given tables hidden: the positions are random walks, for which the mean of the
    neighbours is already the best guess; on sf0.1 the medians are 8.720 nm against 8.725."""
    d = "/root/testdata/sf0.01"
    frames, bundles, index = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("frame_table", "bundle_metadata", "acquisition_index"))
    frames = frames.withColumn("hidden", fn.abs(fn.xxhash64("bundle_id", "frame")) % 10 == 0)
    got = grid.by_bundle(frames.where("not hidden or bundle_id is null"), bundles, index).where("series = 'site1'").toPandas().set_index(["bundle_id", "slot"])
    width = index.select(fn.max("field_width_nm")).first()[0]
    filled = got[got.state == "filled"]
    assert filled.x.between(0, width).all() and filled.y.between(0, width).all()
    rows = frames.where("site1_valid and micro_time_s >= 0 and not isnan(micro_time_s)").join(index, frames.acquisition_id == index.nd2_id).withColumn("slot", fn.floor(fn.col("micro_time_s") / fn.col("median_interval_s") + 0.5))
    seen = rows.where("site1_x_nm between 0 and field_width_nm").groupBy("bundle_id", "slot").agg(fn.avg("site1_x_nm").alias("x"), fn.min("hidden").alias("hidden")).toPandas()
    true = seen[seen.hidden].set_index(["bundle_id", "slot"]).x
    both = filled.join(true.rename("true"), how="inner")
    known = {b: (p.slot.to_numpy(), p.x.to_numpy()) for b, p in seen[~seen.hidden].sort_values("slot").groupby("bundle_id")}
    lines = np.array([np.interp(s, *known[b]) for b, s in both.index])
    assert len(both) > 1000, len(both)
    assert np.median(np.abs(both.x - both.true)) <= 1.05 * np.median(np.abs(lines - both.true))


def test_the_half_step_solves_each_pattern_of_cells_once_and_depends_on_no_block(monkeypatch):
    """Against windows solved one by one; series with the same cells, sources of different lengths, blocks of any size."""
    rng = np.random.default_rng(5)
    series, slots = {"a": ["a_x"], "b": ["b_x", "b_y"]}, [30, 31, 60, 100, 24, 7, 31]
    use = [rng.random(n) < 0.7 for n in slots]
    columns = {"last_slot": pa.array([n - 1 for n in slots], pa.int32()), "slots": pa.array([np.arange(n, dtype=np.int32) for n in slots])}
    columns |= {c: pa.array([rng.normal(size=n).cumsum() for n in slots]) for c in ("a_x", "b_x", "b_y")}
    columns |= {f"{s}_use": pa.array(use) for s in series} | {f"{s}_scale": pa.array([np.ones(len(c))] * len(slots)) for s, c in series.items()}
    batch = pa.RecordBatch.from_pydict(columns)
    v, noise = grid.start_factors(4)
    solved = []
    monkeypatch.setattr(grid, "inverses", lambda a, f=grid.inverses: (solved.append(a.shape[2]), f(a))[1])

    def sums(cells):
        monkeypatch.setattr(grid, "_BLOCK_CELLS", cells)
        return sum(grid.time_equations([grid._rows(*b, 5)[2:4] for b in blocks.values()], v, noise) for _, _, blocks in grid._components(batch, series))

    expected, patterns = np.zeros((grid.WINDOW, 5 * 6 + 2)), set()
    for i, n in enumerate(slots):
        for first in range(0, n, grid.WINDOW // 2):
            at = first + np.flatnonzero(use[i][first : first + grid.WINDOW])
            if len(at) >= 5:
                patterns.add(tuple(at - first))
                w = v[at - first]
                cov = np.linalg.inv(w.T @ w / noise + np.eye(5))
                for c in ("a_x", "b_x", "b_y"):
                    y = columns[c][i].values.to_numpy()[at]
                    y = y - y.mean()
                    u = cov @ w.T @ y / noise
                    moment = np.outer(u, u) + cov
                    left = (y - w @ u) ** 2 + np.einsum("wp,pq,wq->w", w, cov, w)
                    expected[at - first] += np.hstack([np.tile(moment.ravel(), (len(at), 1)), np.outer(y, u), np.ones((len(at), 1)), left[:, None]])
    assert np.allclose(sums(10**6), expected) and sum(solved) == len(patterns)
    assert np.allclose(sums(1), expected) and np.allclose(sums(62), expected)


def test_short_sources_are_not_laid_out_as_wide_as_long_ones():
    batch = pa.RecordBatch.from_pydict({"last_slot": pa.array([9, 149_999] + [9] * 5000, pa.int32())})
    wide = [len(b) * (int(b["last_slot"].to_numpy().max()) + 1) for b in grid._blocks(batch)]
    assert sum(wide) == 150_000 + 10 * 5001 and max(wide) <= grid._BLOCK_CELLS


def test_inverses_are_those_of_numpy():
    m = np.random.default_rng(3).normal(size=(50, 17, 9)) * 30
    a = m @ m.transpose(0, 2, 1) + np.eye(17)
    assert np.allclose(grid.inverses(a.transpose(1, 2, 0).copy()).transpose(2, 0, 1), np.linalg.inv(a), atol=1e-9)


def test_the_windows_of_a_source_are_the_same_beside_longer_ones():
    assert all(list(grid._windows(n)) == [f for f in grid._windows(333) if f < n] for n in range(1, 333))
