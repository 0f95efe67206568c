"""Lag-pair statistics: ordered self-joins of points and velocities of a unit.

Points meet on the unit only, with the frame window as join condition: both sides share one shuffle by unit
and the aggregates by unit and lag need no other. A unit has at most one point per frame of its movie, so
the pairs of a unit are bounded by movie length times lag cap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.numeric import clip, ratio

IDENTITY = ["nd2_id", "crop_id", "hour"]


def max_lag(cap: int = 50, fraction: float = 0.25) -> Column:
    """min(cap, floor(fraction * movie_frames)): the lag grid follows the schedule, not what was observed."""
    return F.least(F.lit(cap), F.floor(F.lit(fraction) * F.col("movie_frames"))).cast("int")


def _pairs(earlier: DataFrame, later: DataFrame, keys: Sequence[str], at: str, first: int, last: Column) -> DataFrame:
    """Rows of `earlier` as a_*, of `later` as b_*, `lag` frames apart, first <= lag <= last (of earlier)."""
    a = earlier.withColumn("last_lag", last).select(*keys, "last_lag", *[F.col(c).alias(f"a_{c}") for c in earlier.columns if c not in keys])
    b = later.select(*keys, *[F.col(c).alias(f"b_{c}") for c in later.columns if c not in keys])
    lag = F.col(f"b_{at}") - F.col(f"a_{at}")
    return a.join(b, list(keys)).where((lag >= first) & (lag <= F.col("last_lag"))).withColumn("lag", lag.cast("int"))


def _elapsed(dt: Column) -> list[Column]:
    return [F.avg(dt).alias("lag_s_mean"), F.median(dt).alias("lag_s_median"), F.min(dt).alias("lag_s_min"), F.max(dt).alias("lag_s_max")]


def mean_squared_displacement(points: DataFrame, min_pairs: int = 8, last: Column | None = None) -> DataFrame:
    """Per unit, site and frame lag: pair_count, value (mean squared displacement; null under min_pairs, as is
    its sample SD), and the elapsed times of the pairs. Lags without any pair have no row."""
    p = points.select("unit_id", "site", "movie_frames", "frame", "time_s", "x", "y")
    pairs = _pairs(p, p.drop("movie_frames"), ["unit_id", "site"], "frame", 1, max_lag() if last is None else last)
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    sq = dx * dx + dy * dy
    out = pairs.groupBy("unit_id", "site", "lag").agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg(sq).alias("value"), F.stddev_samp(sq).alias("sd"), *_elapsed(F.col("b_time_s") - F.col("a_time_s"))
    )
    enough = F.col("pair_count") >= min_pairs
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("value", "sd")})


def velocities(points: DataFrame, deltas: DataFrame | Sequence[int] = (1,)) -> DataFrame:
    """Per unit, site, delta and start frame: displacement over elapsed time. deltas: frame offsets, or a
    table (nd2_id, delta) with offsets of each acquisition."""
    p = points.select("unit_id", "site", "nd2_id", "movie_frames", "frame", "time_s", "x", "y")
    if isinstance(deltas, DataFrame):
        start = p.join(deltas.select("nd2_id", "delta"), "nd2_id")
    else:
        start = p.withColumn("delta", F.explode(F.array(*[F.lit(int(d)) for d in deltas])))
    end = p.select("unit_id", "site", F.col("frame").alias("end_frame"), F.col("time_s").alias("t1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    start = start.withColumn("end_frame", F.col("frame") + F.col("delta"))
    dt = F.col("t1") - F.col("time_s")
    return (
        start.join(end, ["unit_id", "site", "end_frame"])
        .where(dt > 0)
        .select(
            "unit_id", "site", "nd2_id", "movie_frames", "delta",
            F.col("frame").alias("start_frame"), "end_frame", F.col("time_s").alias("start_s"), dt.alias("duration_s"),
            ((F.col("x1") - F.col("x")) / dt).alias("vx"), ((F.col("y1") - F.col("y")) / dt).alias("vy"),
        )
    )


def velocity_autocorrelation(v: DataFrame, min_pairs: int = 8, last: Column | None = None) -> DataFrame:
    """Per unit, site, delta and start-frame lag (0 included): raw mean of v(t+k).v(t), and value, that over the
    mean squared speed of all velocities of the unit (which needs no min_pairs)."""
    keys = ["unit_id", "site", "delta"]
    p = v.select(*keys, "movie_frames", "start_frame", "start_s", "vx", "vy")
    pairs = _pairs(p, p.drop("movie_frames"), keys, "start_frame", 0, max_lag() if last is None else last)
    raw = pairs.groupBy(*keys, "lag").agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.avg(F.col("a_vx") * F.col("b_vx") + F.col("a_vy") * F.col("b_vy")).alias("raw_value"),
        F.median(F.col("b_start_s") - F.col("a_start_s")).alias("lag_s_median"),
    )
    energy = v.groupBy(*keys).agg(F.avg(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("normalization"), F.median("duration_s").alias("delta_s_median"))
    gated = raw.withColumn("raw_value", F.when(F.col("pair_count") >= min_pairs, F.col("raw_value")))
    return gated.join(energy, keys).withColumn("value", ratio(F.col("raw_value"), F.col("normalization")))


DIRECTIONS = {"site1_later_vs_site2": ("site1", "site2"), "site2_later_vs_site1": ("site2", "site1")}


def velocity_cross_correlation(v: DataFrame, min_pairs: int = 8, last: Column | None = None) -> DataFrame:
    """Per unit, delta, direction and lag: the 2x2 matrix <v_later(t+k) v_earlier(t)^T> (xx, xy, yx, yy), its
    trace raw_value, and value, the trace over sqrt(<|v1|^2><|v2|^2>) of each site's own full support, which
    needs min_pairs velocities in both sites and is not clipped; secondary_value is normalised by the energies
    of the paired velocities and clipped to [-1, 1]."""
    keys = ["unit_id", "delta"]
    p = v.select(*keys, "site", "movie_frames", "start_frame", "start_s", "vx", "vy")
    # one join for both directions: the sides differ in site
    pairs = _pairs(p, p.drop("movie_frames"), keys, "start_frame", 0, max_lag() if last is None else last).where("a_site <> b_site")
    way = F.when(F.col("b_site") == "site1", "site1_later_vs_site2").otherwise("site2_later_vs_site1")
    mean = lambda i, j: F.avg(F.col(f"b_v{i}") * F.col(f"a_v{j}"))
    power = lambda s: F.avg(F.col(f"{s}_vx") * F.col(f"{s}_vx") + F.col(f"{s}_vy") * F.col(f"{s}_vy"))
    raw = pairs.groupBy(*keys, way.alias("direction"), "lag").agg(
        F.count(F.lit(1)).alias("pair_count"),
        *[mean(i, j).alias(f"{i}{j}") for i in "xy" for j in "xy"],
        F.sqrt(power("a") * power("b")).alias("lag_energy"),
        F.median(F.col("b_start_s") - F.col("a_start_s")).alias("lag_s_median"),
    )
    sq = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")
    one = lambda s, c: F.when(F.col("site") == s, c)
    n1, n2 = F.count(one("site1", sq)), F.count(one("site2", sq))
    scale = v.groupBy(*keys).agg(
        F.when((n1 >= min_pairs) & (n2 >= min_pairs), F.sqrt(F.avg(one("site1", sq)) * F.avg(one("site2", sq)))).alias("normalization"),
        F.median("duration_s").alias("delta_s_median"),
    )
    enough = F.col("pair_count") >= min_pairs
    gated = raw.withColumns({c: F.when(enough, F.col(c)) for c in ("xx", "xy", "yx", "yy")}).withColumn("raw_value", F.col("xx") + F.col("yy"))
    return gated.join(scale, keys).withColumns(
        {
            "value": ratio(F.col("raw_value"), F.col("normalization")),
            "secondary_value": clip(ratio(F.col("raw_value"), F.col("lag_energy")), -1.0, 1.0),
        }
    )


def matrix_rows(vcc: DataFrame) -> DataFrame:
    """The four components of the matrices as rows: row_component, column_component, raw_value, normalized_value."""
    keep = ["unit_id", "delta", "direction", "lag", "pair_count", "lag_s_median", "normalization"]
    long = vcc.where("xx is not null").select(*keep, F.expr("stack(4,'x','x',xx,'x','y',xy,'y','x',yx,'y','y',yy) as (row_component,column_component,raw_value)"))
    return long.withColumn("normalized_value", ratio(F.col("raw_value"), F.col("normalization")))


def symmetrise(curves: DataFrame, keys: Sequence[str], values: Sequence[str], counts: Sequence[str] = ("pair_count",)) -> DataFrame:
    """Average the two directions of a curve where both exist; counts take the smaller."""
    return (
        curves.groupBy(*keys)
        .agg(*[F.avg(c).alias(c) for c in values], *[F.min(c).alias(c) for c in counts], F.count_distinct("direction").alias("_ways"))
        .where("_ways = 2")
        .drop("_ways")
    )


def transpose_reverse(matrices: DataFrame, reverse: str = "site2_later_vs_site1") -> DataFrame:
    """Matrices of the reverse direction in (site1, site2) order: rows and columns change places."""
    back = F.col("direction") == reverse
    return matrices.withColumns(
        {
            "row_component": F.when(back, F.col("column_component")).otherwise(F.col("row_component")),
            "column_component": F.when(back, F.col("row_component")).otherwise(F.col("column_component")),
        }
    )


def exact_time_pairs(points: DataFrame, lags: Sequence[float], tolerance: float | str) -> DataFrame:
    """For every point and physical lag the nearest later point of its unit within tolerance of t + lag; of
    equally near ones the earlier. tolerance: seconds, or the column of points that holds each unit's own (see
    with_tolerance). A band join on time buckets as wide as the tolerance allows, so a point
    meets only the few points of neighbouring buckets per lag."""
    own = F.col(tolerance) if isinstance(tolerance, str) else F.lit(float(tolerance))
    p = points.select("unit_id", "site", F.col("frame").cast("int").alias("frame"), "time_s", "x", "y", own.alias("tolerance"))
    tolerance, width = F.col("tolerance"), F.greatest(2 * F.col("tolerance"), F.lit(1e-9))
    a = p.withColumn("want", F.explode(F.array(*[F.lit(float(x)) for x in lags])))
    spot = F.floor((F.col("time_s") + F.col("want")) / width)
    a = a.withColumn("bucket", F.explode(F.array(spot - 1, spot, spot + 1)))
    b = p.select("unit_id", "site", *[F.col(c).alias(f"b_{c}") for c in ("frame", "time_s", "x", "y")], F.floor(F.col("time_s") / width).alias("bucket"))
    error = F.abs((F.col("b_time_s") - F.col("time_s")) - F.col("want"))
    later = F.when(F.col("want") > 0, F.col("b_time_s") > F.col("time_s")).otherwise(F.col("b_time_s") >= F.col("time_s"))
    near = a.join(b, ["unit_id", "site", "bucket"]).where((error <= tolerance) & later)
    keys = ["unit_id", "site", "want", "frame"]
    best = near.groupBy(*keys).agg(
        F.min(F.struct(error.alias("error"), "b_time_s", F.struct("time_s", "x", "y", "b_frame", "b_x", "b_y").alias("rest"))).alias("m")
    )
    return best.select(*keys, "m.error", "m.b_time_s", "m.rest.*")


def exact_time_msd(points: DataFrame, lags: Sequence[float], tolerance: float, min_pairs: int = 8) -> DataFrame:
    """Mean squared displacement at physical lags, of the nearest-time pairs."""
    dx, dy = F.col("b_x") - F.col("x"), F.col("b_y") - F.col("y")
    out = exact_time_pairs(points, lags, tolerance).groupBy("unit_id", "site", F.col("want").alias("lag_s")).agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg(dx * dx + dy * dy).alias("value")
    )
    return out.withColumn("value", F.when(F.col("pair_count") >= min_pairs, F.col("value")))


def exact_time_velocities(points: DataFrame, delta_s: float, tolerance: float) -> DataFrame:
    """Velocities over the physical duration delta_s."""
    dt = F.col("b_time_s") - F.col("time_s")
    return exact_time_pairs(points, [delta_s], tolerance).select(
        "unit_id", "site", F.col("frame").alias("start_frame"), F.col("b_frame").alias("end_frame"), F.col("time_s").alias("start_s"),
        dt.alias("duration_s"), ((F.col("b_x") - F.col("x")) / dt).alias("vx"), ((F.col("b_y") - F.col("y")) / dt).alias("vy"),
    )


def exact_time_correlation(v1: DataFrame, v2: DataFrame, lags: Sequence[float], tolerance: float, min_pairs: int = 8, pooled_energy: bool = False) -> DataFrame:
    """Correlation of v1(t + lag) with v2(t) at physical start-time lags: VAC if both are one site
    (pooled_energy: denominator without support gate), else scalar VCC."""
    starts = lambda v: v.select("unit_id", F.lit("v").alias("site"), F.col("start_frame").alias("frame"), F.col("start_s").alias("time_s"), F.col("vx").alias("x"), F.col("vy").alias("y"))
    width = max(2 * tolerance, 1e-9)
    a = starts(v2).withColumn("want", F.explode(F.array(*[F.lit(float(x)) for x in lags])))
    spot = F.floor((F.col("time_s") + F.col("want")) / width)
    a = a.withColumn("bucket", F.explode(F.array(spot - 1, spot, spot + 1)))
    b = starts(v1).select("unit_id", *[F.col(c).alias(f"b_{c}") for c in ("time_s", "x", "y")], F.floor(F.col("time_s") / width).alias("bucket"))
    error = F.abs((F.col("b_time_s") - F.col("time_s")) - F.col("want"))
    later = F.when(F.col("want") > 0, F.col("b_time_s") > F.col("time_s")).otherwise(F.col("b_time_s") >= F.col("time_s"))
    near = a.join(b, ["unit_id", "bucket"]).where((error <= tolerance) & later)
    best = near.groupBy("unit_id", "want", "frame").agg(F.min(F.struct(error.alias("e"), "b_time_s", "x", "y", "b_x", "b_y")).alias("m"))
    raw = best.groupBy("unit_id", F.col("want").alias("lag_s")).agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg(F.col("m.x") * F.col("m.b_x") + F.col("m.y") * F.col("m.b_y")).alias("raw_value")
    )
    power = lambda v, c: v.groupBy("unit_id").agg(F.avg(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias(c), F.count(F.lit(1)).alias(f"n_{c}"))
    both = raw.join(power(v1, "e1"), "unit_id").join(power(v2, "e2"), "unit_id")
    supported = F.lit(True) if pooled_energy else (F.col("n_e1") >= min_pairs) & (F.col("n_e2") >= min_pairs)
    norm = F.when(supported, F.sqrt(F.col("e1") * F.col("e2")))
    raw_value = F.when(F.col("pair_count") >= min_pairs, F.col("raw_value"))
    return both.select("unit_id", "lag_s", "pair_count", raw_value.alias("raw_value"), norm.alias("normalization"), ratio(raw_value, norm).alias("value"))


def with_tolerance(points: DataFrame, longest_lag: float) -> DataFrame:
    """points with the column tolerance of their unit where none is given: rounding of the times about the unit's
    first, and one unit in the last place of the times themselves."""
    eps = 2.0**-52
    per = points.groupBy("unit_id", "site").agg((F.max("time_s") - F.min("time_s")).alias("_span"), F.max(F.abs("time_s")).alias("_size"))
    need = F.greatest(64 * eps * F.greatest(F.lit(1.0), F.lit(abs(float(longest_lag))), F.col("_span")), eps * F.col("_size"))
    return points.join(per.select("unit_id", "site", need.alias("tolerance")), ["unit_id", "site"])


def exact_time_turning(points: DataFrame, delta_s: float, tolerance: float) -> DataFrame:
    """Turning angles of velocities over a physical duration; the two steps share the very same vertex frame."""
    return turning_angles(exact_time_velocities(points, delta_s, tolerance).withColumn("delta", F.lit(0)))


class ExactTimeSupportError(ValueError):
    """No lag of a default time grid has enough pairs."""


def require_support(curve: DataFrame, min_pairs: int) -> DataFrame:
    """Fail if no lag of the curve has min_pairs pairs: jittered clocks need the frame-step statistics."""
    if curve.where(F.col("pair_count") >= min_pairs).isEmpty():
        raise ExactTimeSupportError(f"no lag has {min_pairs} pairs within the tolerance")
    return curve


def default_time_lags(points: DataFrame, cap: int = 50, fraction: float = 0.25) -> DataFrame:
    """(unit_id, site, lag_s): multiples 1..min(cap, floor(fraction * n)) of the median step of each unit."""
    along = Window.partitionBy("unit_id", "site").orderBy("frame")
    steps = points.withColumn("step", F.col("time_s") - F.lag("time_s").over(along))
    grid = steps.groupBy("unit_id", "site").agg(F.median("step").alias("step"), F.count(F.lit(1)).alias("n"))
    most = F.least(F.lit(cap), F.floor(F.col("n") * fraction)).cast("int")
    return grid.where(most >= 1).select("unit_id", "site", F.explode(F.transform(F.sequence(F.lit(1), most), lambda k: k * F.col("step"))).alias("lag_s"))


def integrate_curve(curves: DataFrame, keys: Sequence[str], min_pairs: int, minimum_duration: float, positive_only: bool = False, cutoff: float | None = None) -> DataFrame:
    """Trapezoid area over adjacent supported lags, never bridging an unsupported one. curves: keys, lag,
    lag_s_median, value, pair_count; lags of the grid without pairs must have rows (count 0) or be absent as
    numbers, in which case neighbours in `lag` are not adjacent."""
    from trackloom.functions.numeric import positive_area

    along = Window.partitionBy(*keys).orderBy("lag")
    t, y = F.col("lag_s_median"), F.col("value")
    ok = t.isNotNull() & y.isNotNull() & (F.col("pair_count") >= min_pairs)
    if cutoff is not None:
        ok = ok & (t <= cutoff)
    rows = curves.withColumn("ok", ok).withColumns(
        {
            "width": F.lead("lag_s_median").over(along) - t,
            "next_value": F.lead("value").over(along),
            "linked": F.col("ok") & F.lead("ok").over(along) & (F.lead("lag").over(along) == F.col("lag") + 1),
        }
    )
    on = lambda c: F.sum(F.when(F.col("linked"), c))
    area = positive_area(y, F.col("next_value"), F.col("width")) if positive_only else (y + F.col("next_value")) * F.col("width") / 2
    out = rows.groupBy(*keys).agg(
        F.count_if("ok").alias("supported_lags"),
        F.count_if("linked").alias("intervals"),
        F.coalesce(on(F.col("width")), F.lit(0.0)).alias("duration"),
        on(area).alias("area"),
        F.count_if(F.col("linked") & (F.col("width") <= 0)).alias("_still"),
    )
    reason = (
        F.when(F.col("supported_lags") < 2, "fewer_than_two_supported_lags")
        .when(F.col("_still") > 0, "non_increasing_supported_lag_times")
        .when(F.col("intervals") == 0, "no_adjacent_supported_lags")
        .when(F.col("duration") < minimum_duration, "insufficient_supported_duration")
    )
    return out.withColumn("reason", reason).withColumn("area", F.when(F.col("reason").isNull(), F.col("area"))).drop("_still")


def turning_angles(v: DataFrame) -> DataFrame:
    """Angle between successive velocities that share the exact vertex frame; zero-length steps have none."""
    keys = ["unit_id", "site", "delta"]
    a = v.where("vx <> 0 or vy <> 0").select(*keys, "start_frame", F.col("end_frame").alias("vertex"), F.col("start_s").alias("t0"), F.col("duration_s").alias("d0"), F.col("vx").alias("ux"), F.col("vy").alias("uy"))
    b = v.where("vx <> 0 or vy <> 0").select(*keys, F.col("start_frame").alias("vertex"), "end_frame", "start_s", "duration_s", "vx", "vy")
    dot = F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy")
    size = F.sqrt((F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")) * (F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    return a.join(b, [*keys, "vertex"]).select(
        *keys, "start_frame", "vertex", "end_frame", F.acos(clip(dot / size, -1.0, 1.0)).alias("angle"),
        (F.col("start_s") - F.col("d0")).alias("from_s"), (F.col("start_s") + F.col("duration_s")).alias("to_s"),
    )


def angle_histogram(turns: DataFrame, keys: Sequence[str], bins: int = 18) -> DataFrame:
    """Counts and probabilities over [0, pi] in equal bins, the last closed; empty bins are kept."""
    import math

    index = F.least(F.lit(bins - 1), F.floor(F.col("angle") / (math.pi / bins))).cast("int")
    counted = turns.groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("probability", ratio(F.col("n").cast("double"), F.col("total")))


def turning_persistence(turns: DataFrame, keys: Sequence[str], degrees: float = 30.0) -> DataFrame:
    """P(angle <= threshold), P(angle >= pi - threshold) and their difference."""
    import math

    limit = math.radians(degrees)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("turns"), share(F.col("angle") <= limit).alias("forward"), share(F.col("angle") >= math.pi - limit).alias("backward"))
    return out.withColumn("persistence", F.col("forward") - F.col("backward"))


def directed_bursts(turns: DataFrame, degrees: float, min_turns: int, min_duration: float) -> DataFrame:
    """Runs of consecutive turns within the threshold that share their steps: gaps and islands."""
    import math

    keys = ["unit_id", "site", "delta"]
    along = Window.partitionBy(*keys).orderBy("vertex")
    place = turns.withColumn("place", F.row_number().over(along)).where(F.col("angle") <= math.radians(degrees))
    runs = Window.partitionBy(*keys).orderBy("place")
    follows = (F.lag("place").over(runs) == F.col("place") - 1) & (F.lag("vertex").over(runs) == F.col("start_frame"))
    island = F.sum(F.when(follows, 0).otherwise(1)).over(runs)
    out = place.withColumn("burst", island).groupBy(*keys, "burst").agg(
        F.min("start_frame").alias("first_frame"), F.max("end_frame").alias("last_frame"), F.count(F.lit(1)).alias("turns"),
        (F.max("to_s") - F.min("from_s")).alias("duration_s"), F.avg("angle").alias("mean_angle"), F.max("angle").alias("max_angle"),
    )
    return out.where((F.col("turns") >= min_turns) & (F.col("duration_s") >= min_duration)).drop("burst")


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: str, out: str) -> DataFrame:
    """(keys, out): the longest run of consecutive numbers in `order` among rows where `flag` holds; 0 if none."""
    run = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    runs = df.where(flag).select(*keys, order).distinct().withColumn("_run", run).groupBy(*keys, "_run").count()
    longest = runs.groupBy(*keys).agg(F.max("count").alias(out))
    return df.select(*keys).distinct().join(longest, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(0)))
