"""Unit curves of all metrics, and binned cross-correlations, from dense frame arrays, many units at a time.

The joins of `lags` build every pair of frames as a row; for the full family of curves that is hundreds of
pairs per frame. Here a task lays the units of a batch side by side as (unit, frame) arrays with holes and
takes each lag as one shifted difference of the arrays. Same definitions, same results; measured on sf0.1
with 8 cores this is several times as fast. One shuffle brings a unit's frames together; a unit has at most
one row per frame of its movie, and a task holds one batch and one unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CURVES = (
    "metric string, unit_id string, site string, direction string, delta int, lag int, lag_s_median double, delta_s_median double, "
    "value double, raw_value double, sd double, pair_count long, normalization double"
)
NAMES = [c.split()[0] for c in CURVES.split(", ")]


def _middle(x: np.ndarray) -> np.ndarray:
    """Median along the rows of the numbers in x; NaN where there is none."""
    x = np.sort(x, axis=1)  # NaN last
    n = np.isfinite(x).sum(1)
    row, some = np.arange(len(x)), n > 0
    k = np.maximum(n, 1)
    return np.where(some, (x[row, (k - 1) // 2] + x[row, k // 2]) / 2, np.nan) if x.shape[1] else np.full(len(x), np.nan)


def _mean(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    there = ~np.isnan(x)
    n = there.sum(1)
    return n, np.divide(np.where(there, x, 0.0).sum(1), n, out=np.full(len(x), np.nan), where=n > 0)


class _Rows:
    """Finite curve points, kept as column pieces until the end."""

    NUMBERS = ("lag_s_median", "delta_s_median", "value", "raw_value", "sd", "normalization")

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.at: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.tags: list[tuple] = []
        self.numbers: dict[str, list] = {c: [] for c in self.NUMBERS}

    def put(self, metric: str, lag: int, n: np.ndarray, ok: np.ndarray, site: str | None = None, direction: str | None = None, delta: int | None = None, **columns) -> None:
        at = np.flatnonzero(ok)
        self.at.append(at)
        self.pairs.append(n[at])
        self.tags.append((metric, site, direction, delta, lag))
        for c, parts in self.numbers.items():
            parts.append(columns[c][at] if c in columns else np.full(len(at), np.nan))

    def seen(self, metric: str, n: np.ndarray, ok: np.ndarray, min_pairs: int, site: str | None = None, direction: str | None = None, delta: int | None = None) -> None:
        """Curves keep no account of the lags without a point."""

    def frame(self) -> pd.DataFrame:
        sizes = [len(a) for a in self.at]
        tags = pd.DataFrame(self.tags, columns=["metric", "site", "direction", "delta", "lag"]).astype({"metric": object, "site": object, "direction": object, "delta": "Int32", "lag": "int32"})
        out = tags.iloc[np.repeat(np.arange(len(sizes)), sizes)].reset_index(drop=True)
        out = out.assign(unit_id=self.ids[np.concatenate(self.at)], pair_count=np.concatenate(self.pairs), **{c: np.concatenate(p) for c, p in self.numbers.items()})
        return out[NAMES]


class _Census:
    """What became of the lags of every unit and curve, in place of the curves."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.sums: dict[tuple, np.ndarray] = {}

    def seen(self, metric: str, n: np.ndarray, ok: np.ndarray, min_pairs: int, site: str | None = None, direction: str | None = None, delta: int | None = None) -> None:
        own = self.sums.setdefault((metric, site, direction, delta), np.zeros((5, len(self.ids)), np.int64))
        enough = n >= min_pairs
        own[:4] += np.array([np.ones(len(n), bool), ok, ~enough, enough & ~ok])
        own[4] = np.maximum(own[4], n)

    def put(self, *args, **columns) -> None:
        """The points themselves are not kept."""

    def frame(self) -> pd.DataFrame:
        parts = []
        for (metric, site, direction, delta), counts in self.sums.items():
            part = pd.DataFrame(dict(zip(("attempted", "emitted", "below_min_pairs", "invalid", "most_pairs"), counts)))
            parts.append(part.assign(metric=metric, unit_id=self.ids, site=site, direction=direction, delta=pd.array([delta] * len(part), "Int32")))
        return pd.concat(parts, ignore_index=True)[[c.split()[0] for c in CENSUS.split(", ")]]


CENSUS = "metric string, unit_id string, site string, direction string, delta int, attempted long, emitted long, below_min_pairs long, invalid long, most_pairs long"


def _displacement(out: _Rows, metric: str, site: str, x: np.ndarray, y: np.ndarray, t: np.ndarray, last: int, min_pairs: int) -> None:
    for k in range(1, last + 1):
        sq = (x[:, k:] - x[:, :-k]) ** 2 + (y[:, k:] - y[:, :-k]) ** 2
        n, mean = _mean(sq)
        ok = n >= min_pairs
        out.seen(metric, n, ok, min_pairs, site=site)
        if not ok.any():
            continue
        spread = np.nansum((sq - mean[:, None]) ** 2, 1)
        sd = np.sqrt(np.divide(spread, n - 1, out=np.full(len(n), np.nan), where=n > 1))
        dt = np.where(np.isfinite(sq), t[:, k:] - t[:, :-k], np.nan)
        out.put(metric, k, n, ok, site=site, lag_s_median=_middle(dt), value=mean, raw_value=mean, sd=sd)


def _velocity(x: np.ndarray, y: np.ndarray, t: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vx, vy, duration by start frame, NaN where there is none."""
    dt = t[:, d:] - t[:, :-d]
    ok = (dt > 0) & np.isfinite(x[:, d:] - x[:, :-d])
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = (x[:, d:] - x[:, :-d]) / dt, (y[:, d:] - y[:, :-d]) / dt
    return np.where(ok, vx, np.nan), np.where(ok, vy, np.nan), np.where(ok, dt, np.nan)


def _correlations(out: _Rows, xs: list, ys: list, t: np.ndarray, d: int, last: int, min_pairs: int) -> None:
    if d >= t.shape[1]:
        return
    v = [_velocity(x, y, t, d) for x, y in zip(xs, ys)]
    start = t[:, : t.shape[1] - d]
    power = [_mean(vx**2 + vy**2) for vx, vy, _ in v]
    own_delta = [_middle(w[2]) for w in v]
    both_delta = _middle(np.hstack([w[2] for w in v]))
    enough = (power[0][0] >= min_pairs) & (power[1][0] >= min_pairs)
    scale = np.where(enough, np.sqrt(power[0][1] * power[1][1]), np.nan)
    ways = [("vac", "site1", None, 0, 0), ("vac", "site2", None, 1, 1), ("vcc", None, "site1_later_vs_site2", 0, 1), ("vcc", None, "site2_later_vs_site1", 1, 0)]
    for k in range(0, min(last, start.shape[1] - 1) + 1):
        early = slice(0, start.shape[1] - k)
        dt = start[:, k:] - start[:, early]
        for metric, site, direction, a, b in ways:
            product = v[a][0][:, k:] * v[b][0][:, early] + v[a][1][:, k:] * v[b][1][:, early]
            n, raw = _mean(product)
            norm = power[a][1] if metric == "vac" else scale
            ok = (n >= min_pairs) & np.isfinite(norm) & (norm > 0)
            out.seen(metric, n, ok, min_pairs, site=site, direction=direction, delta=d)
            if not ok.any():
                continue
            lag_s = np.full(len(n), np.nan)
            lag_s[ok] = _middle(np.where(np.isfinite(product[ok]), dt[ok], np.nan))
            value = np.divide(raw, norm, out=np.full(len(n), np.nan), where=ok)
            out.put(metric, k, n, ok, site=site, direction=direction, delta=d, lag_s_median=lag_s, delta_s_median=own_delta[a] if metric == "vac" else both_delta, value=value, raw_value=raw, normalization=norm)


def _side_by_side(pdf: pd.DataFrame) -> Iterator[tuple]:
    """Units of one movie length and offset family as (unit, frame) arrays with holes: ids, movie length, offsets and
    the arrays of time, x1, y1, x2 and y2."""
    first = pdf.drop_duplicates("unit_id")
    for (movie, deltas), group in first.groupby(["movie_frames", "deltas"], sort=False):
        for cut in range(0, len(group), 256):
            ids = group["unit_id"].to_numpy(object)[cut : cut + 256]
            own = pdf[pdf["unit_id"].isin(ids)]
            row = pd.Index(ids).get_indexer(own["unit_id"])
            col = own["frame"].to_numpy() - 1
            arrays = [np.full((len(ids), movie), np.nan) for _ in range(5)]
            for array, name in zip(arrays, ("time_s", "x1", "y1", "x2", "y2")):
                array[row, col] = own[name].to_numpy(float)
            yield ids, movie, deltas, arrays


def _curves(pdf: pd.DataFrame, cap: int, fraction: float, min_pairs: int, kind: type = _Rows) -> Iterator[pd.DataFrame]:
    """Curves of whole units, or their census. Units of one movie length and offset family are laid side by side."""
    for ids, movie, deltas, (t, x1, y1, x2, y2) in _side_by_side(pdf):
        out, last = kind(ids), min(cap, int(np.floor(fraction * movie)))
        _displacement(out, "msd", "site1", x1, y1, t, last, min_pairs)
        _displacement(out, "msd", "site2", x2, y2, t, last, min_pairs)
        _displacement(out, "mscd", "pair", x2 - x1, y2 - y1, t, last, min_pairs)
        for d in map(int, deltas.split()):
            _correlations(out, [x1, x2], [y1, y2], t, d, last, min_pairs)
        if out.at if kind is _Rows else out.sums:
            yield out.frame()


def unit_curves(frames: DataFrame, deltas: DataFrame, min_pairs: int = 8, cap: int = 50, fraction: float = 0.25) -> DataFrame:
    """The finite points of msd, mscd, vac and vcc curves, as `schedules.unit_curves` gives them. frames: one row per
    unit and frame with 1 <= frame <= movie_frames (see points.bundle_frames); deltas: nd2_id, delta."""
    return _by_unit(frames, deltas, CURVES, lambda pdf: _curves(pdf, cap, fraction, min_pairs))


def support_census(frames: DataFrame, deltas: DataFrame, min_pairs: int = 8, cap: int = 50, fraction: float = 0.25) -> DataFrame:
    """Every attempted curve with the numbers of its lags: attempted, emitted (a point), below_min_pairs and invalid
    (enough pairs but no positive normalisation), and the most pairs of a lag. Curves without any lag have no row."""
    return _by_unit(frames, deltas, CENSUS, lambda pdf: _curves(pdf, cap, fraction, min_pairs, _Census))


STEPS = "unit_id string, site string, lag int, pair_count long, value double, sd double, lag_s_mean double, lag_s_median double, lag_s_min double, lag_s_max double"


def displacements(frames: DataFrame, channels: Sequence[str] = ("site1", "site2"), min_pairs: int = 8, cap: int = 50, fraction: float = 0.25) -> DataFrame:
    """What lags.mean_squared_displacement gives for the points of the channels (site1, site2, pair), from the frames."""
    def steps(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for ids, movie, _, arrays in _side_by_side(pdf):
            t, x1, y1, x2, y2 = arrays
            place = {"site1": (x1, y1), "site2": (x2, y2), "pair": (x2 - x1, y2 - y1)}
            parts = []
            for site in channels:
                x, y = place[site]
                for k in range(1, min(cap, int(np.floor(fraction * movie))) + 1):
                    sq = (x[:, k:] - x[:, :-k]) ** 2 + (y[:, k:] - y[:, :-k]) ** 2
                    n = np.isfinite(sq).sum(1)
                    at = np.flatnonzero(n)
                    if not len(at):
                        continue
                    sq, n = sq[at], n[at]
                    mean = np.nansum(sq, 1) / n
                    spread = np.nansum((sq - mean[:, None]) ** 2, 1)
                    enough = n >= min_pairs
                    dt = np.where(np.isfinite(sq), (t[:, k:] - t[:, :-k])[at], np.nan)
                    sd = np.sqrt(np.divide(spread, n - 1, out=np.full(len(n), np.nan), where=n > 1))
                    parts.append(pd.DataFrame({
                        "unit_id": ids[at], "site": site, "lag": k, "pair_count": n, "value": np.where(enough, mean, np.nan), "sd": np.where(enough, sd, np.nan),
                        "lag_s_mean": np.nansum(dt, 1) / n, "lag_s_median": _middle(dt), "lag_s_min": np.nanmin(dt, 1), "lag_s_max": np.nanmax(dt, 1),
                    }))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    found = _by_unit(frames, None, STEPS, steps)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("value", "sd")})


SYMMETRIC = "unit_id string, delta int, lag int, center double, value double, pair_count long, delta_s_median double"


def _lagged_sums(later: np.ndarray, earlier: np.ndarray, last: int) -> np.ndarray:
    """Sum over t of later[t + k] * earlier[t] for k = 0..last, by unit; holes are zeros."""
    ahead = np.pad(later, ((0, 0), (0, last)))
    return np.einsum("ukt,ut->uk", sliding_window_view(ahead, earlier.shape[1], axis=1), earlier)


def _near_centers(ok: np.ndarray, pairs: np.ndarray, d: int, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, lag and center of the points that curves.scaled_bins takes: of the lags whose nearest center it is (of
    equals the lower) the nearest, then that of most pairs, then the smallest. ok, pairs: by unit and lag."""
    k = np.arange(ok.shape[1])
    off = np.abs(k[:, None] / d - centers)
    place = off.argmin(1)
    rank = np.unique(np.round(off[k, place], 12), return_inverse=True)[1]
    most, none = int(pairs.max(initial=0)), np.iinfo(np.int64).max
    order = np.where(ok, (rank * (most + 1) + most - pairs) * len(k) + k, none)
    first = np.flatnonzero(np.diff(place, prepend=-1))  # lags of a center lie together
    best = np.minimum.reduceat(order, first, axis=1)
    unit, at = np.nonzero(best < none)
    return unit, best[unit, at] % len(k), centers[place[first]][at]


def _symmetric(pdf: pd.DataFrame, centers: np.ndarray, min_pairs: int) -> Iterator[pd.DataFrame]:
    kinds = pdf[["unit_id", "movie_frames", "deltas"]].drop_duplicates()
    mixed = kinds["unit_id"].duplicated(keep=False)  # frames of several acquisitions: such a unit goes by itself
    groups = [g["unit_id"].to_numpy(object) for _, g in kinds[~mixed].groupby(["movie_frames", "deltas"], sort=False)]
    groups = [g[cut : cut + 256] for g in groups for cut in range(0, len(g), 256)] + [np.array([u], object) for u in kinds["unit_id"][mixed].unique()]
    group, row = (pd.Series(np.concatenate(x), np.concatenate(groups)) for x in ([np.full(len(g), i) for i, g in enumerate(groups)], [np.arange(len(g)) for g in groups]))
    unit = pdf["unit_id"]
    pdf = pdf.assign(group=group.reindex(unit).to_numpy(), row=row.reindex(unit).to_numpy())
    for i, own in pdf.groupby("group", sort=False):
        ids, movies, families = groups[i], own["movie_frames"].unique(), own["deltas"].unique()
        at = own["row"].to_numpy(), own["frame"].to_numpy() - 1
        width = int(own["frame"].max())
        t, x1, y1, x2, y2, movie = (np.full((len(ids), width), np.nan) for _ in range(6))
        for array, name in ((t, "time_s"), (x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"), (movie, "movie_frames")):
            array[at] = own[name].to_numpy(float)
        for d in sorted({int(d) for f in families for d in f.split()}):
            starts = width - d
            if starts < 1:
                continue
            one, two = _velocity(x1, y1, t, d), _velocity(x2, y2, t, d)
            if len(families) > 1:  # a velocity starts where its own acquisition has the offset
                begins = np.zeros(t.shape, bool)
                begins[at] = own["deltas"].map({f: str(d) in f.split() for f in families}).to_numpy(bool)
                one, two = ([np.where(begins[:, :starts], c, np.nan) for c in v] for v in (one, two))
            power = [_mean(v[0] ** 2 + v[1] ** 2) for v in (one, two)]
            scale = np.sqrt(power[0][1] * power[1][1])
            supported = (power[0][0] >= min_pairs) & (power[1][0] >= min_pairs) & ~(scale <= 0)
            if not supported.any():
                continue
            use = np.flatnonzero(supported)
            last = min(int(np.floor(centers[-1] * d + 1e-12)), starts - 1)
            sites = [[~np.isnan(v[0][use]), *(np.nan_to_num(c[use], nan=0.0, posinf=np.inf, neginf=-np.inf) for c in v[:2])] for v in (one, two)]
            pairs, raw = [], []
            for later, earlier in (sites, sites[::-1]):
                sums = [np.zeros((len(use), last + 1)) for _ in range(3)]
                for m in movies:
                    reach = min(last, m - 1)
                    here = 1.0 if len(movies) == 1 else movie[use, :starts] == m
                    for total, a, b in zip(sums, later, earlier):
                        total[:, : reach + 1] += _lagged_sums(a.astype(float), b * here, reach)
                pairs.append(np.rint(sums[0]).astype(np.int64))
                raw.append(np.divide(sums[1] + sums[2], sums[0], out=np.zeros_like(sums[0]), where=sums[0] > 0))
            fewer = np.minimum(*pairs)
            u, lag, center = _near_centers(fewer >= min_pairs, fewer, d, centers)
            if len(u):
                value = (raw[0][u, lag] + raw[1][u, lag]) / 2 / scale[use][u]
                middle = _middle(np.hstack([one[2][use], two[2][use]]))
                yield pd.DataFrame({"unit_id": ids[use[u]], "delta": d, "lag": lag, "center": center, "value": value, "pair_count": fewer[u, lag], "delta_s_median": middle[u]})


def symmetric_cross_correlation(frames: DataFrame, deltas: DataFrame, centers: Sequence[float], min_pairs: int = 8) -> DataFrame:
    """Per unit, offset and scaled-lag center the point that curves.scaled_bins takes from lags.velocity_cross_correlation,
    symmetrised, at lags up to the last center. frames, deltas: as for unit_curves."""
    found = _by_unit(frames, deltas, SYMMETRIC, lambda pdf: _symmetric(pdf, np.array(centers), min_pairs), "left", 100_000)
    return found.withColumn("value", F.coalesce("value", F.lit(float("nan"))))  # NaN of infinite energies comes back as null


def _by_unit(frames: DataFrame, deltas: DataFrame | None, schema: str, make: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], how: str = "inner", least: int = 0) -> DataFrame:
    """make applied to batches of whole units, of `least` rows if there are as many. how: frames of an acquisition
    without offsets are left out (inner) or have none (left)."""
    if deltas is None:
        named = frames.withColumn("deltas", F.lit(""))
    else:
        named = frames.join(deltas.groupBy("nd2_id").agg(F.array_join(F.array_sort(F.collect_set("delta")), " ").alias("deltas")), "nd2_id", how).withColumn("deltas", F.coalesce("deltas", F.lit("")))
    rows = (
        named.select("unit_id", "frame", "movie_frames", "deltas", "time_s", "x1", "y1", "x2", "y2")
        .repartition("unit_id")
        .sortWithinPartitions("unit_id", "frame")
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < max(least, 1):
                continue
            pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
            last = pdf["unit_id"].iloc[-1]
            open_ = (pdf["unit_id"] == last).to_numpy()
            held = [pdf[open_]]
            if not open_.all():
                yield from make(pdf[~open_])
        if sum(map(len, held)):
            yield from make(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(task, schema)
