"""Implausible readings: spikes, stuck values, limit violations and times out of order, per source.

Each source (bundle) and field is a series in frame order. A robust autoregression on its steps,
step_t = phi * clip(step_{t-1}) + e_t with scale = median absolute step, scores every reading by its
residual. A reading with a large residual opens a run of at most three, and the reading after the run
decides between two hypotheses by its residuals: additive outlier (it is predicted from before the run) or
level shift (it is predicted from the run). Outliers are taken out and the fit repeated until nothing new is
found. Runs of equal readings and physical limits are separate findings and are not part of the fit.

A spike is an outlier that the exact rule confirms: all readings of the run lie more than FAR median steps
from the reading before, the reading after is back within half of the run's least distance, and no frame is
absent in between. The tests' margins are the largest values the autoregressive terms can take (they are
clipped), so every run that the rule confirms passes them: |back - before| <= distance / 2 implies
|back - before| <= |back - run|. Outliers that the rule does not confirm are reported as `outlier`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDINGS = "bundle_id string, frame long, field string, kind string, score double, score_outlier double, score_shift double"
SCORES = ("score", "score_outlier", "score_shift")
FAR, LONGEST, LEAST, STUCK, CLIP = 12.0, 3, 20, 4, 3.0


def segment_medians(values: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """Median per segment; NaN for empty segments."""
    out = np.full(n, np.nan)
    if len(values):
        order = np.lexsort((values, seg))
        v, s = values[order], seg[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        out[s[first]] = (v[first + (size - 1) // 2] + v[first + size // 2]) / 2
    return out


def _stuck(x: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Readings that repeat the one before them in a run of STUCK or more."""
    same = np.r_[False, (x[1:] == x[:-1]) & (seg[1:] == seg[:-1])]
    run = np.cumsum(~same) - 1
    return same & (np.bincount(run)[run] >= STUCK) if len(x) else same


def _outliers(
    x: np.ndarray, frame: np.ndarray, place: np.ndarray, seg: np.ndarray, n: int, long_enough: np.ndarray
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Spikes, other outliers and level shifts by kind, and their scores (residual, and the residuals of the reading
    after the run under either hypothesis, all in scales). place: ordinal among all readings of the series, so
    that place and frame advance alike exactly where no frame is absent or unread. long_enough: by segment."""
    m = len(x)
    spike, odd, shift = np.zeros(m, bool), np.zeros(m, bool), np.zeros(m, bool)
    scores = np.full((3, m), np.nan)
    if m < 2:
        return {"spike": spike, "outlier": odd, "level_shift": shift}, scores
    step = np.r_[0.0, x[1:] - x[:-1]]
    inner = np.r_[False, seg[1:] == seg[:-1]]
    scale = segment_medians(np.abs(step[inner]), seg[inner], n)[seg]
    unit = np.where(scale > 0, scale, np.nan)
    able = inner & long_enough[seg]
    keep = np.ones(m, bool)
    while True:
        # robust AR(1) on the steps between readings that are not yet outliers, both factors clipped
        psi = np.clip(step, -CLIP * scale, CLIP * scale)
        before = np.where(np.r_[False, inner[:-1]], np.r_[0.0, psi[:-1]], 0.0)
        usable = able & np.r_[False, inner[:-1]] & keep
        xy = np.bincount(seg[usable], (psi * before)[usable], n)
        xx = np.bincount(seg[usable], (before * before)[usable], n)
        phi = np.clip(np.divide(xy, xx, out=np.zeros(n), where=xx > 0), -1, 1)[seg]
        residual = step - phi * before
        # |step| > 12 scales implies |residual| > (12 - 3 |phi|) scales, as the regressor is clipped at 3
        far = (FAR - CLIP * np.abs(phi)) * scale
        start = np.flatnonzero(able & (np.abs(residual) > far))
        found, doubt, stays = np.zeros(m, bool), np.zeros(m, bool), np.zeros(m, bool)
        if len(start):
            base, f, own = x[start - 1], phi[start], scale[start]
            running, ruled = np.ones(len(start), bool), np.ones(len(start), bool)
            returned, doubtful = np.zeros(len(start), bool), np.zeros(len(start), int)
            distance, drift, power = np.full(len(start), np.inf), f * before[start], np.ones(len(start))
            for k in range(LONGEST):
                last, after = start + k, start + k + 1
                a, q = np.minimum(after, m - 1), np.minimum(last, m - 1)
                distance = np.minimum(distance, np.abs(x[q] - base))
                there = (after < m) & (seg[a] == seg[start])
                running &= there & (distance > far[start])
                ruled &= there & (distance > FAR * own)
                power = power * f
                drift = drift + power * f * before[start]
                outlier, stay = np.abs(x[a] - base - drift), np.abs(x[a] - x[q] - f * psi[q])
                margin = CLIP * np.abs(f) * own * (k + 3)
                accepted = running & (outlier - stay <= margin)
                gapless = (frame[a] - frame[start - 1]) == (place[a] - place[start - 1])
                back = accepted & ruled & gapless & (np.abs(x[a] - base) <= distance / 2)
                for j in range(k + 1):
                    found[start[back] + j] = True
                likely = accepted & (outlier < stay) & (doubtful == 0)
                doubtful[likely] = k + 1
                returned |= back
                tell = back | likely | (running & ~returned & (doubtful == 0))
                scores[1, start[tell]], scores[2, start[tell]] = (outlier / unit[start])[tell], (stay / unit[start])[tell]
            for j in range(LONGEST):
                doubt[start[doubtful > j] + j] = True
            settled = returned | (doubtful > 0)
            # no reading within reach is better predicted from before: the step lasts
            stays[start] = ~settled & (np.abs(x[start] - base) > FAR * own)
            scores[0, start] = residual[start] / unit[start]
        fresh = found & ~spike
        spike |= found
        odd = doubt & ~spike
        shift = stays & ~spike & ~odd & ~np.r_[False, (spike | odd)[:-1]]  # the way back from an outlier is no shift
        if not fresh.any():
            return {"spike": spike, "outlier": odd, "level_shift": shift}, scores
        keep &= ~fresh


def _out_of_order(t: np.ndarray) -> np.ndarray:
    """Positions outside a longest strictly increasing subsequence; of equal times the first stays."""
    n = len(t)
    tails, at, prev = [], [], np.full(n, -1)
    for i, v in enumerate(t.tolist()):
        lo, hi = 0, len(tails)
        while lo < hi:
            mid = (lo + hi) // 2
            if tails[mid] < v:
                lo = mid + 1
            else:
                hi = mid
        if lo:
            prev[i] = at[lo - 1]
        if lo == len(tails):
            tails.append(v)
            at.append(i)
        elif v < tails[lo]:  # an equal time does not displace the first
            tails[lo], at[lo] = v, i
    out = np.ones(n, bool)
    i = at[-1] if at else -1
    while i >= 0:
        out[i] = False
        i = prev[i]
    return out


def _examine(pdf: pd.DataFrame, positions: Sequence[str], time: str | None) -> pd.DataFrame:
    """Findings of whole series, sorted by bundle and frame."""
    ids, seg = np.unique(pdf["bundle_id"].to_numpy(object), return_inverse=True)
    frame, width = pdf["frame"].to_numpy(np.int64), pdf["limit"].to_numpy(float)
    parts = []

    def put(rows: np.ndarray, field: str, kind: str, scores: np.ndarray | None = None) -> None:
        if len(rows):
            numbers = np.full((3, len(rows)), np.nan) if scores is None else scores
            own = {"bundle_id": ids[seg[rows]], "frame": frame[rows], "field": field, "kind": kind}
            parts.append(pd.DataFrame({**own, **dict(zip(SCORES, numbers))}))

    for name in positions:
        value = pdf[name].to_numpy(float)
        rows = np.flatnonzero(~np.isnan(value))
        x, s, f = value[rows], seg[rows], frame[rows]
        bad = (x < 0) | np.isinf(x) | (x > width[rows])
        put(rows[bad], name, "limit")
        stuck = _stuck(x, s) & ~bad
        put(rows[stuck], name, "stuck")
        good = np.flatnonzero(~(bad | stuck))
        long_enough = np.bincount(s, minlength=len(ids)) >= LEAST
        kinds, scores = _outliers(x[good], f[good], good, s[good], len(ids), long_enough)
        for kind, on in kinds.items():
            put(rows[good[on]], name, kind, scores[:, on])
    if time:
        value = pdf[time].to_numpy(float)
        rows = np.flatnonzero(~np.isnan(value))
        t, s = value[rows], seg[rows]
        put(rows[t < 0], time, "limit")
        rows, s, t = rows[t >= 0], s[t >= 0], t[t >= 0]
        steps = np.r_[True, (t[1:] > t[:-1]) | (s[1:] != s[:-1])] if len(t) else np.zeros(0, bool)
        for b in np.unique(s[~steps]):
            own = np.flatnonzero(s == b)
            put(rows[own[_out_of_order(t[own])]], time, "time_order")
    if not parts:
        kinds = {"frame": "int64", **dict.fromkeys(SCORES, "float64")}
        return pd.DataFrame({c: pd.Series([], dtype=kinds.get(c, object)) for c in ("bundle_id", "frame", "field", "kind", *SCORES)})
    return pd.concat(parts, ignore_index=True)


def implausible_readings(
    frames: DataFrame,
    limits: DataFrame,
    positions: Sequence[str] = ("site1_x_nm", "site1_y_nm", "site2_x_nm"),
    time: str | None = "micro_time_s",
) -> DataFrame:
    """Findings (bundle_id, frame, field, kind, score, score_outlier, score_shift), kind one of limit, stuck, spike,
    outlier, level_shift, time_order. score: residual of the autoregression; score_outlier and score_shift: that of
    the reading after the run, predicted from before the run and from the run; all in median absolute steps, null
    for the kinds that are not tested and where the median step is 0.

    frames: acquisition_id, bundle_id, frame, loaded_at and the fields; limits: acquisition_id, limit (the
    largest possible position, null for none), one row per acquisition. Level shifts are reported but are
    plausible, and outliers that the rule does not confirm are only likely. Rows with null bundle_id or frame have no series and are left out; null and NaN readings are
    missing; of rows repeated for a (bundle_id, frame) the one loaded first counts. Series of under 20
    readings get no spike test. Empty input gives an empty result.

    Repeated rows are combined before the shuffle by bundle, after which a bundle has one row per frame of
    its movie; a task streams its bundles in order and holds one batch and one bundle at a time.
    """
    fields = [*positions, *([time] if time else [])]
    single = (
        frames.where(F.col("bundle_id").isNotNull() & F.col("frame").isNotNull())
        .groupBy("bundle_id", F.col("frame").cast("long").alias("frame"))
        .agg(
            *[F.min_by(F.col(c).cast("double"), "loaded_at").alias(c) for c in fields],
            F.min_by("acquisition_id", "loaded_at").alias("acquisition_id"),
        )
    )
    series = (
        single.join(limits, "acquisition_id", "left")
        .select("bundle_id", "frame", *fields, F.col("limit").cast("double").alias("limit"))
        .repartition("bundle_id")
        .sortWithinPartitions("bundle_id", "frame")
    )

    def examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            ids = pdf["bundle_id"].to_numpy(object)
            cut = int(np.flatnonzero(ids != ids[-1])[-1] + 1) if (ids != ids[-1]).any() else 0
            held = pdf.iloc[cut:]
            if cut:
                yield _examine(pdf.iloc[:cut], positions, time)
        if held is not None and len(held):
            yield _examine(held, positions, time)

    found = series.mapInPandas(examine, FINDINGS)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in SCORES})
