"""Irregular readings onto a regular grid, with missing cells filled by low-rank factorisation.

Every source gets one entry per period of its group's clock. Cells with a reading are observed and keep it
exactly. The source-by-time matrix of each component (a coordinate) is cut into windows of WINDOW periods
that overlap by half and stacked: rows are windows of sources, columns the periods of a window. Each row is
centred and divided by its source's median step, and alternating least squares fits
row = source factor . time factors on the observed cells. A missing cell takes the fitted value of the
window in which it lies most central, if that window and that period of all windows have enough observed
cells; elsewhere it stays unsupported.

The time factors are WINDOW x (rank + 1) numbers however many sources, groups and periods there are, so
they and their normal equations are a fixed-size message between driver and tasks. Source factors are
solved in the tasks and never leave them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.spikes import segment_medians
from trackloom.session import written

STATES = pa.array(["unsupported", "filled", "observed"])
WINDOW, FAR, PRIOR = 24, 12.0, 10.0
_BLOCK_CELLS = 200_000  # cells laid out as dense arrays at a time
_PATTERNS = 512  # patterns of cells solved at a time; their matrices fit the processor's cache


def slot_readings(frames: DataFrame, clocks: DataFrame, series: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (group_id, source_id, slot): per series whether a reading is there, and its mean components.
    Rows with null time or outside the grid go to slot -1, which only shows that the source exists.
    Combined map-side, so a source that holds much of the rows reduces to its slots."""
    slot = F.floor(F.col("time_s") / F.col("period_s") + 0.5)
    placed = frames.join(clocks, "group_id").withColumn(
        "slot", F.when((slot >= 0) & (slot <= F.col("last_slot")), slot).otherwise(F.lit(-1)).cast("int")
    )
    return placed.groupBy("group_id", "source_id", "slot").agg(
        F.max("counts").alias("counts"),
        *[F.max(f"{s}_seen").alias(f"{s}_seen") for s in series],
        *[F.avg(F.when(F.col(f"{s}_seen"), F.col(c))).alias(c) for s, parts in series.items() for c in parts],
    )


def _places(batch: pa.RecordBatch) -> tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]:
    """Shape of the dense arrays of the sources in batch, and row and column of each listed slot with whether it has one."""
    col = _flat(batch, "slots")
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch["slots"]).to_numpy())
    return (len(batch), int(batch["last_slot"].to_numpy().max()) + 1), row, col, col >= 0


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """What the lists of a column hold, end to end; NaN for null."""
    return batch[name].flatten().to_numpy(zero_copy_only=False)


def _dense(batch: pa.RecordBatch, places: tuple, names: Sequence[str], kind: type) -> dict[str, np.ndarray]:
    """Sources by slots of the listed columns: False or NaN where none."""
    shape, row, col, on = places
    out = {}
    for c in names:
        out[c] = np.full(shape, np.nan if kind is float else False, kind)
        out[c][row[on], col[on]] = _flat(batch, c).astype(kind)[on]
    return out


def _fit_cells(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells the factors are fitted to and the scale of each source (its median step): readings outside
    low..high, and readings more than FAR scales from the median of the two before and after, stay out."""
    with np.errstate(invalid="ignore"):
        use = np.isfinite(value) & (value >= low[:, None]) & (value <= high[:, None])
    seg, col = np.nonzero(use)
    x = value[seg, col]
    inner = seg[1:] == seg[:-1]
    scale = segment_medians(np.abs(np.diff(x))[inner], seg[1:][inner], len(value))
    scale = np.where(scale > 0, scale, 1.0)
    around = np.full((4, len(x)), np.nan)
    for k, shift in enumerate((-2, -1, 1, 2)):
        at = np.arange(len(x)) + shift
        there = (at >= 0) & (at < len(x))
        there[there] = seg[at[there]] == seg[there]
        around[k, there] = x[at[there]]
    around = np.sort(around, axis=0)  # NaN last
    n = np.maximum((~np.isnan(around)).sum(0), 1)
    middle = (np.take_along_axis(around, ((n - 1) // 2)[None], 0)[0] + np.take_along_axis(around, (n // 2)[None], 0)[0]) / 2
    far = np.abs(x - middle) > FAR * scale[seg]
    use[seg[far], col[far]] = False
    return use, scale


def _windows(slots: int) -> range:
    """First periods of the windows: half a window apart, so that every source's last periods have one of their own,
    however many periods the sources beside it have."""
    return range(0, slots, WINDOW // 2)


def _rows(value: np.ndarray, use: np.ndarray, scale: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Windows with at least `least` cells: source, first period, cells in use, standardised values, means. value and
    scale have the components of a series as second axis; they share their cells."""
    slots = value.shape[2]
    v, u = np.pad(np.where(use[:, None], value, 0.0), [(0, 0), (0, 0), (0, WINDOW)]), np.pad(use, [(0, 0), (0, WINDOW)])
    out = []
    for first in _windows(slots):
        o = u[:, first : first + WINDOW]
        n = o.sum(1)
        at = np.flatnonzero(n >= least)
        o = o[at]
        here = v[:, :, first : first + WINDOW][at]
        mean = here.sum(2) / n[at, None]
        y = np.where(o[:, None], here - mean[..., None], 0.0) / scale[at][..., None]
        out.append((at, np.full(len(at), first), o, y, mean))
    return tuple(np.concatenate(c) for c in zip(*out))


def start_factors(rank: int) -> tuple[np.ndarray, float]:
    """Time factors of a random walk, and the variance that the ranks left out would hold: the level and the
    slowest cosines of the window with the walk's spectrum. Deterministic and of full rank."""
    k = np.arange(1, WINDOW)
    size = 1.4826 * np.sqrt(2 / WINDOW) / np.sqrt(2 - 2 * np.cos(np.pi * k / WINDOW))
    t = (np.arange(WINDOW) + 0.5) / WINDOW
    waves = np.cos(np.pi * np.outer(t, k)) * size
    rest = (waves[:, rank:] ** 2).sum(1).mean() if rank < WINDOW - 1 else 0.0
    return np.hstack([np.full((WINDOW, 1), float(WINDOW)), waves[:, :rank]]), max(rest, 0.02)


def inverses(a: np.ndarray) -> np.ndarray:
    """Inverses, in place, of matrices I + A, A symmetric and not negative, side by side on the last axis. Each pivot is
    swept out of all of them at once, in strips that cover the lower triangle. No rows are exchanged: the pivots are 1 at
    least, and rounding can't make them less."""
    q = len(a)
    strips = [(np.empty((min(top + 4, q) - top, min(top + 4, q), a.shape[2])), slice(top, top + 4)) for top in range(0, q, 4)]
    for k in range(q):
        col = np.concatenate([a[k, :k], a[k:, k]])
        pivot = 1 / np.maximum(col[k], 1.0)
        row = col * pivot
        for change, own in strips:
            part = a[own, : change.shape[1]]
            np.multiply(col[own, None], row[: change.shape[1]], out=change)
            np.subtract(part, change, out=part)
        a[k, :k], a[k + 1 :, k], a[k, k] = row[:k], row[k + 1 :], -pivot
    for k in range(q):
        a[:k, k] = a[k, :k]
    return np.negative(a, out=a)


def source_factors(rows: Sequence[tuple[np.ndarray, np.ndarray]], v: np.ndarray, noise: float) -> Iterator[tuple]:
    """Least-squares source factors of the rows of all series, each series given by its rows' cells and their values.
    Rows with the same cells share a covariance whatever their series, so each pattern of cells is solved once.
    Yields some patterns at a time (periods by patterns), their covariances (patterns last) and for each series the rows
    that have them, the pattern of each (ascending) and its factors, one line per component. The unit ridge is the
    factors' own spread (the time factors carry the size), so every system is positive definite."""
    q = v.shape[1]
    bits = [np.packbits(o, axis=1).astype(np.int64) @ (256 ** np.arange(-(-WINDOW // 8))) for o, _ in rows]
    every, some = np.unique(np.concatenate(bits), return_index=True)
    cells = np.concatenate([o for o, _ in rows])[some]
    order = [np.argsort(b, kind="stable") for b in bits]
    number = [np.searchsorted(every, b[at]) for b, at in zip(bits, order)]
    squares = _squares(v).T / noise
    for first in range(0, len(every), _PATTERNS):
        on = cells[first : first + _PATTERNS].T.astype(float)
        cov = inverses((squares @ on).reshape(q, q, -1) + np.eye(q)[..., None])
        each = np.ascontiguousarray(cov.transpose(2, 0, 1))
        solved = []
        for (_, y), at, n in zip(rows, order, number):
            low, high = np.searchsorted(n, (first, first + _PATTERNS))
            own, pattern = at[low:high], n[low:high] - first
            right = (y[own].reshape(-1, WINDOW) @ v).reshape(len(own), -1, q) / noise
            solved.append((own, pattern, np.matmul(right, each[pattern])))
        yield on, cov, solved


def _squares(v: np.ndarray) -> np.ndarray:
    return (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)


def time_equations(rows: Sequence[tuple[np.ndarray, np.ndarray]], v: np.ndarray, noise: float) -> np.ndarray:
    """Sums over the rows of all series for the other half step, one line per period of the window: Gram matrix,
    right-hand side, cells, squared residuals. They add up over tasks."""
    q = v.shape[1]
    moments, right, count, misfit = np.zeros((WINDOW, q * q)), np.zeros((WINDOW, q)), np.zeros(WINDOW), np.zeros(WINDOW)
    for on, cov, solved in source_factors(rows, v, noise):
        cov = cov.reshape(q * q, -1)
        times = np.zeros(on.shape[1])
        for (o, y), (at, pattern, u) in zip(rows, solved):
            times += np.bincount(pattern, minlength=len(times)) * y.shape[1]
            here, seen, flat = y[at], o[at].astype(float), u.reshape(-1, q)
            moments += seen.T @ np.matmul(u.transpose(0, 2, 1), u).reshape(-1, q * q)
            right += here.reshape(-1, WINDOW).T @ flat
            miss = ((here - (flat @ v.T).reshape(here.shape)) * seen[:, None]).reshape(-1, WINDOW)
            misfit += np.einsum("nw,nw->w", miss, miss)
        moments += on @ (cov * times).T
        misfit += (on * (_squares(v) @ cov)) @ times
        count += on @ times
    return np.hstack([moments, right, count[:, None], misfit[:, None]])


def solve_time(total: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Time factors and noise from summed equations. The starting factors count as PRIOR further rows, so few rows
    move them little and no system is singular."""
    q = start.shape[1]
    gram, right = total[:, : q * q].reshape(-1, q, q), total[:, q * q : q * q + q]
    new = np.linalg.solve(gram + PRIOR * np.eye(q), (right + PRIOR * start)[..., None])[..., 0]
    return new, max(float(total[:, -1].sum() / max(total[:, -2].sum(), 1.0)), 1e-3)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The sources in blocks of at most _BLOCK_CELLS dense cells (one source at least), those with the most periods
    first, so that short sources are not laid out as wide as long ones."""
    last = batch["last_slot"].to_numpy()
    order, start = np.argsort(-last, kind="stable"), 0
    while start < len(order):
        end = start + max(1, _BLOCK_CELLS // (int(last[order[start]]) + 1))
        yield batch.take(pa.array(order[start:end]))
        start = end


def _high(batch: pa.RecordBatch) -> np.ndarray:
    high = batch["limit"].to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(high), np.inf, high)


def _with_fit_cells(batch: pa.RecordBatch, series: Mapping[str, Sequence[str]], signed: Sequence[str]) -> pa.RecordBatch:
    """batch with the cells of each series to which all its components can be fitted, and the components' scales."""
    places = _places(batch)
    shape, row, col, on = places
    value, high = _dense(batch, places, [c for parts in series.values() for c in parts], float), _high(batch)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch["slots"]).to_numpy())])
    out = dict(zip(batch.schema.names, batch.columns))
    for s, parts in series.items():
        fit = [_fit_cells(value[c], -high if s in signed else np.zeros(len(high)), high) for c in parts]
        use = np.logical_and.reduce([f[0] for f in fit])
        flags = np.zeros(len(row), bool)
        flags[on] = use[row[on], col[on]]
        scale = np.stack([f[1] for f in fit], 1)
        out[f"{s}_use"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flags))
        out[f"{s}_scale"] = pa.ListArray.from_arrays(pa.array(np.arange(len(scale) + 1) * len(parts), pa.int32()), pa.array(scale.ravel()))
    return pa.RecordBatch.from_pydict(out)


def _components(batch: pa.RecordBatch, series: Mapping[str, Sequence[str]]) -> Iterator[tuple]:
    """Blocks of sources, with per series its values (components as second axis), the cells to fit to and the scales."""
    for own in _blocks(batch):
        places = _places(own)
        value = _dense(own, places, [c for parts in series.values() for c in parts], float)
        use = _dense(own, places, [f"{s}_use" for s in series], bool)
        yield own, places, {s: (np.stack([value[c] for c in parts], 1), use[f"{s}_use"], _flat(own, f"{s}_scale").reshape(len(own), -1)) for s, parts in series.items()}


def regular_grid(
    frames: DataFrame,
    sources: DataFrame,
    clocks: DataFrame,
    series: Mapping[str, Sequence[str]],
    signed: Sequence[str] = (),
    rank: int = 16,
    rounds: int = 8,
    tolerance: float = 0.02,
    least_cells: int = 5,
) -> DataFrame:
    """(bundle_id, slot, series, state, x, y, sd) with state observed, filled or unsupported.

    series: name -> its one or two components. frames: group_id, source_id, time_s, counts (boolean; a source
    needs one true), per series <series>_seen and its components. sources: source_id, the sources wanted.
    clocks: group_id, period_s, last_slot and limit (the largest possible component; null for none), one row
    per group. signed: series whose components run from -limit, the others from 0. Other columns are ignored.

    Rows without source or clock, null or not positive periods and sources absent from `sources` give no
    entries. A frame with null or NaN time, or outside slots 0..last_slot, fills no slot. A slot with a true
    flag but no value is observed with null components. Repeated rows change nothing but the mean of their
    slot. Observed cells keep their mean reading even where it is impossible; such readings and spikes (see
    _fit_cells) only stay out of the fit. A fill outside the limits is unsupported instead. sd is the model's
    standard deviation of a fill. Empty tables give an empty result.

    Rounds end when the noise changes by less than `tolerance` (relative), or after `rounds`.

    Cost: one shuffle of readings combined by slot, one of slots gathered by source (at most last_slot + 2
    per source), then a pass over that table per round, which sends WINDOW x (rank + 2)^2 sums per task.
    """
    names = [c for parts in series.values() for c in parts]
    clocks = clocks.where((F.col("period_s") > 0) & F.col("last_slot").isNotNull() & (F.col("last_slot") >= 0)).select(
        "group_id", "period_s", F.col("last_slot").cast("int").alias("last_slot"), F.col("limit").cast("double").alias("limit")
    )
    slots = slot_readings(frames.where(F.col("source_id").isNotNull()), clocks, series)
    cells = ["slot", *[f"{s}_seen" for s in series], *names]
    gathered = (
        slots.groupBy("group_id", "source_id")
        .agg(F.max("counts").alias("counts"), F.collect_list(F.struct(*cells)).alias("cells"))
        .where("counts")
        .join(sources.select("source_id").distinct().hint("shuffle_hash"), "source_id", "left_semi")
        .join(clocks, "group_id")
        .select(
            "source_id",
            "last_slot",
            "limit",
            F.col("cells.slot").alias("slots"),
            *[F.transform(f"cells.{s}_seen", lambda x: F.coalesce(x, F.lit(False))).alias(f"{s}_seen") for s in series],
            *[F.col(f"cells.{c}").alias(c) for c in names],
        )
    )

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (_with_fit_cells(own, series, signed) for own in _blocks(batch))

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in gathered.schema] + [f"`{s}_use` array<boolean>, `{s}_scale` array<double>" for s in series]
    matrix = written(gathered.mapInArrow(prepare, ", ".join(kinds)))
    fitted = matrix.select("last_slot", "slots", *names, *[f"{s}_{c}" for s in series for c in ("use", "scale")])
    start, noise = start_factors(rank)
    v, known = start, np.zeros(WINDOW, bool)
    width = (rank + 1) * (rank + 2) + 2
    for _ in range(rounds):

        def equations(batches: Iterator[pa.RecordBatch], v: np.ndarray = v, noise: float = noise) -> Iterator[pa.RecordBatch]:
            total = np.zeros((WINDOW, width))
            for batch in batches:
                for _, _, blocks in _components(batch, series):
                    total += time_equations([_rows(*block, least_cells)[2:4] for block in blocks.values()], v, noise)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(WINDOW + 1) * width, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_pydict({"period": pa.array(np.arange(WINDOW), pa.int32()), "sums": sums})

        sums = fitted.mapInArrow(equations, "period int, sums array<double>").select("period", F.posexplode("sums").alias("at", "part"))
        lines = sums.groupBy("period", "at").agg(F.sum("part").alias("total")).collect()  # WINDOW x width numbers, whatever the input
        total = np.zeros((WINDOW, width))
        for period, at, part in lines:
            total[period, at] = part
        if not total[:, -2].any():
            break
        before = noise
        v, noise = solve_time(total, start)
        known = total[:, -2] >= least_cells
        if abs(noise - before) <= tolerance * before:
            break

    def entries(batches: Iterator[pa.RecordBatch], v: np.ndarray = v, noise: float = noise, known: np.ndarray = known) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, places, blocks in _components(batch, series):
                seen, high = _dense(own, places, [f"{s}_seen" for s in series], bool), _high(own)
                inside = np.arange(places[0][1]) <= own["last_slot"].to_numpy()[:, None]
                row, col = np.nonzero(inside)
                ids = own["source_id"].take(pa.array(row))
                fills = _fill(list(blocks.values()), [seen[f"{s}_seen"] | ~inside for s in series], v, noise, known, least_cells)
                for (s, block), (found, sd) in zip(blocks.items(), fills):
                    low = -high if s in signed else np.zeros(len(high))
                    with np.errstate(invalid="ignore"):
                        able = ((found >= low[:, None, None]) & (found <= high[:, None, None])).all(1)
                    state = np.where(seen[f"{s}_seen"], 2, able.astype(int))[row, col]
                    out = {"bundle_id": ids, "slot": pa.array(col, pa.int64()), "series": pa.repeat(s, len(row)), "state": STATES.take(pa.array(state))}
                    for k, name in enumerate("xy"):
                        number = np.where(state == 2, block[0][row, k, col], np.where(state == 1, found[row, k, col], np.nan)) if k < found.shape[1] else np.full(len(row), np.nan)
                        out[name] = pa.array(number, from_pandas=True)
                    out["sd"] = pa.array(np.where(state == 1, sd[row, col], np.nan), from_pandas=True)
                    yield pa.RecordBatch.from_pydict(out)

    return matrix.mapInArrow(entries, "bundle_id string, slot long, series string, state string, x double, y double, sd double")


def _fill(blocks: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], settled: Sequence[np.ndarray], v: np.ndarray, noise: float, known: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per series, fitted values and standard deviation of the cells not settled, from the window in which each is most
    central among those whose time factors are known there."""
    rows = []
    for block, done in zip(blocks, settled):
        at, first, *rest = _rows(*block, least)
        left = np.pad(~done, [(0, 0), (0, WINDOW)])
        own = np.flatnonzero(sliding_window_view(left, WINDOW, axis=1)[at, first].any(1))  # a window without missing cells needs no factors
        rows.append([c[own] for c in (at, first, *rest)])
    values, variances = [np.empty_like(r[3]) for r in rows], [np.empty(r[2].shape) for r in rows]
    for _, cov, solved in source_factors([(r[2], r[3]) for r in rows], v, noise):
        variance = (_squares(v) @ cov.reshape(v.shape[1] ** 2, -1)).T + noise
        for value, spread, (at, pattern, u) in zip(values, variances, solved):
            value[at], spread[at] = (u.reshape(-1, v.shape[1]) @ v.T).reshape(len(u), -1, WINDOW), variance[pattern]
    beside = np.where(known, np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2), np.inf)
    out = []
    for (value, _, scale), (at, first, _, _, mean), fitted, variance in zip(blocks, rows, values, variances):
        sources, parts, slots = value.shape
        found, spread, off = np.full((sources, slots + WINDOW, parts), np.nan), np.full((sources, slots + WINDOW), np.nan), np.full((sources, slots + WINDOW), np.inf)
        for f in np.unique(first):
            own = np.flatnonzero(first == f)
            part, size = np.ix_(at[own], np.arange(f, f + WINDOW)), scale[at[own]]
            nearer = beside < off[part]
            moved = (fitted[own] * size[..., None] + mean[own][..., None]).transpose(0, 2, 1)
            found[part] = np.where(nearer[..., None], moved, found[part])
            spread[part] = np.where(nearer, np.sqrt(variance[own] * (size**2).sum(1)[:, None]), spread[part])
            off[part] = np.where(nearer, beside, off[part])
        out.append((found[:, :slots].transpose(0, 2, 1), spread[:, :slots]))
    return out


def _finite(v: Column) -> Column:
    return F.when(F.abs(v) < float("inf"), F.when(~F.isnan(v), v))


def by_bundle(frame_table: DataFrame, bundle_metadata: DataFrame, acquisition_index: DataFrame) -> DataFrame:
    """The grid of the frame table: series site1 (its position) and paired (the vector from site 1 to site 2)."""
    across = lambda a: F.col(f"site2_{a}_nm") - F.col(f"site1_{a}_nm")
    frames = frame_table.select(
        F.col("acquisition_id").alias("group_id"),
        F.col("bundle_id").alias("source_id"),
        F.when(~F.isnan("micro_time_s"), F.col("micro_time_s")).alias("time_s"),
        F.col("site1_valid").isNotNull().alias("counts"),
        F.col("site1_valid").alias("site1_seen"),
        F.col("paired_valid").alias("paired_seen"),
        *[_finite(F.col(f"site1_{a}_nm")).alias(f"site1_{a}") for a in "xy"],
        *[_finite(across(a)).alias(f"paired_{a}") for a in "xy"],
    )
    clocks = acquisition_index.groupBy(F.col("nd2_id").alias("group_id")).agg(
        F.max("median_interval_s").alias("period_s"), F.max("movie_duration_s").alias("duration_s"), F.max("field_width_nm").alias("limit")
    )
    clocks = clocks.withColumn("last_slot", F.floor(F.col("duration_s") / F.col("period_s") + 0.5))
    sources = bundle_metadata.select(F.col("bundle_id").alias("source_id")).where("source_id is not null")
    return regular_grid(frames, sources, clocks, {s: [f"{s}_x", f"{s}_y"] for s in ("site1", "paired")}, signed=["paired"])
