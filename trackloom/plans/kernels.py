"""Lag-pair statistics over the frame table, with DuckDB SQL that restates each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.numeric import LARGE, TIE, rounded
from trackloom.operators import dense, lags, points, resampling, schedules
from trackloom.session import written
from trackloom.sources.tables import named_sql, named_table as table


def frames(spark: SparkSession, d: str) -> DataFrame:
    return points.bundle_frames(table(spark, d, "frame_table"), table(spark, d, "acquisition_index"))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned once: the self-joins read both their sides from it."""
    return points.site_points(written(frames(spark, d)))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def k_msd(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.displacements(frames(spark, d)))


def k_mscd(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.displacements(frames(spark, d), ["pair"]))


def k_velocity(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.velocities(_sites(spark, d), [1, 4]).drop("movie_frames"))


def k_vac(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.velocity_autocorrelation(lags.velocities(_sites(spark, d), [2])))


def _vcc(spark: SparkSession, d: str) -> DataFrame:
    return lags.velocity_cross_correlation(lags.velocities(_sites(spark, d), [2]))


def k_vcc(spark: SparkSession, d: str) -> DataFrame:
    return _round(_vcc(spark, d).drop("xx", "xy", "yx", "yy", "lag_energy"))


def k_vcc_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.matrix_rows(_vcc(spark, d)))


def k_vcc_symmetric(spark: SparkSession, d: str) -> DataFrame:
    found = _vcc(spark, d).where("value is not null")
    return _round(lags.symmetrise(found, ["unit_id", "delta", "lag"], ["value", "raw_value", "lag_s_median"]))


def k_matrix_symmetric(spark: SparkSession, d: str) -> DataFrame:
    rows = lags.transpose_reverse(lags.matrix_rows(_vcc(spark, d)))
    keys = ["unit_id", "delta", "lag", "row_component", "column_component"]
    return _round(lags.symmetrise(rows, keys, ["raw_value", "normalized_value"]))


def a_matrix_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hour mean and SD of the symmetrised matrices, every unit with equal weight."""
    own = written(frames(spark, d))
    vcc = lags.velocity_cross_correlation(lags.velocities(points.site_points(own), [2]))
    keys = ["unit_id", "delta", "lag", "row_component", "column_component"]
    unit = lags.symmetrise(lags.transpose_reverse(lags.matrix_rows(vcc)), keys, ["raw_value", "normalized_value"])
    hours = own.groupBy("unit_id").agg(F.min("hour").alias("hour"))
    return _round(
        unit.join(hours, "unit_id").groupBy("hour", "lag", "row_component", "column_component").agg(
            F.count(F.lit(1)).alias("n_units"), F.avg("normalized_value").alias("normalized_mean"), F.stddev_samp("normalized_value").alias("normalized_sd"),
            F.avg("raw_value").alias("raw_mean"), F.stddev_samp("raw_value").alias("raw_sd"), F.sum("pair_count").alias("total_pairs"),
        )
    )


TARGETS = (10.0, 20.0, 40.0)


def _target_velocities(spark: SparkSession, d: str) -> DataFrame:
    """Velocities over the offsets of each acquisition that come nearest to the targets."""
    deltas = schedules.matched_delta(points.acquisition_clock(table(spark, d, "frame_table")), TARGETS)
    return written(lags.velocities(_sites(spark, d), written(deltas.where("delta is not null").select("nd2_id", "delta").distinct())))


def target_lags():
    return F.least(F.col("movie_frames") - 1, F.floor(2.5 * F.col("delta") + 1e-12)).cast("int")


def k_vac_targets(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.velocity_autocorrelation(_target_velocities(spark, d), last=target_lags()))


def k_vcc_targets(spark: SparkSession, d: str) -> DataFrame:
    found = lags.velocity_cross_correlation(_target_velocities(spark, d), last=target_lags()).where("value is not null")
    return _round(lags.symmetrise(found, ["unit_id", "delta", "lag"], ["value", "raw_value", "lag_s_median"]))


EXACT = ([5.0, 10.0, 20.0], 0.25)


def k_msd_exact_time(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.exact_time_msd(_sites(spark, d), *EXACT))


def k_mscd_exact_time(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.exact_time_msd(points.paired_points(written(frames(spark, d))), *EXACT))


def k_velocity_exact_time(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.exact_time_velocities(_sites(spark, d), 10.0, 0.25))


def k_vcc_exact_time(spark: SparkSession, d: str) -> DataFrame:
    v = lags.exact_time_velocities(_sites(spark, d), 10.0, 0.25)
    return _round(lags.exact_time_correlation(v.where("site = 'site1'"), v.where("site = 'site2'"), [0.0, 10.0], 0.25))


def k_vac_exact_time(spark: SparkSession, d: str) -> DataFrame:
    v = lags.exact_time_velocities(_sites(spark, d), 10.0, 0.25).where("site = 'site1'")
    return _round(lags.exact_time_correlation(v, v, [0.0, 10.0], 0.25, pooled_energy=True))


def k_turning_exact_time(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.exact_time_turning(_sites(spark, d), 10.0, 0.25).drop("delta"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return lags.turning_angles(lags.velocities(_sites(spark, d), [1]))


def k_turning(spark: SparkSession, d: str) -> DataFrame:
    return _round(_turns(spark, d))


def k_direction_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.angle_histogram(_turns(spark, d), ["unit_id", "site"]))


def k_turning_persistence(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.turning_persistence(_turns(spark, d), ["unit_id", "site"]))


def k_persistence_null(spark: SparkSession, d: str) -> DataFrame:
    return resampling.shuffled_persistence(lags.velocities(_sites(spark, d), [1]), shuffles=100, seed=1)


def k_directed_bursts(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.directed_bursts(_turns(spark, d), 60.0, 3, 2.0))


def k_positive_area(spark: SparkSession, d: str) -> DataFrame:
    vac = lags.velocity_autocorrelation(lags.velocities(_sites(spark, d), [2]))
    return _round(lags.integrate_curve(vac, ["unit_id", "site"], 8, 5.0, positive_only=True, cutoff=60.0))


def k_curve_area(spark: SparkSession, d: str) -> DataFrame:
    return _round(lags.integrate_curve(lags.mean_squared_displacement(_sites(spark, d)), ["unit_id", "site"], 8, 5.0))


def k_pair_modes(spark: SparkSession, d: str) -> DataFrame:
    return _round(points.pair_modes(frames(spark, d)))


def k_motion_energy(spark: SparkSession, d: str) -> DataFrame:
    v = lags.velocities(_sites(spark, d), [1])
    one, two = (v.where(F.col("site") == f"site{s}").select("unit_id", "start_frame", F.col("vx").alias(f"x{s}"), F.col("vy").alias(f"y{s}")) for s in (1, 2))
    return _round(points.aggregate_coherent_fraction(points.motion_energy(one.join(two, ["unit_id", "start_frame"])), "unit_id"))


def u_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedules.schedule_report(table(spark, d, "frame_table"), table(spark, d, "acquisition_index"))


def u_matched_delta(spark: SparkSession, d: str) -> DataFrame:
    return _round(schedules.matched_delta(points.acquisition_clock(table(spark, d, "frame_table")), (10.0, 20.0, 40.0)))


def _curves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = written(frames(spark, d))
    return own, schedules.unit_curves(own, points.acquisition_clock(table(spark, d, "frame_table")))


def u_unit_curves(spark: SparkSession, d: str) -> DataFrame:
    return _round(_curves(spark, d)[1])


def computed_curves(spark: SparkSession, d: str) -> DataFrame:
    """The unit curves computed from the frames, under the names of the delivered unit_curves table."""
    c = _curves(spark, d)[1]
    return c.select(
        "metric", "unit_id", F.col("unit_id").alias("bundle_id"), "nd2_id", "crop_id", F.col("hour").alias("hour_post_delivery"), "site", "direction", F.col("is_primary").alias("is_primary_matched_10s"),
        F.col("delta_s_median").alias("delta_median_s"), F.col("lag").cast("long").alias("lag_frames"), F.col("lag_s_median").alias("lag_median_s"), (F.col("lag_s_median") / F.col("delta_s_median")).alias("scaled_lag_tau_over_delta"),
        "value", "raw_value", F.col("sd").alias("endpoint_pair_sd"), "pair_count", "normalization",
    )


def u_support_census(spark: SparkSession, d: str) -> DataFrame:
    own = written(frames(spark, d))
    every = lags.mean_squared_displacement(points.site_points(own)).withColumn("metric", F.lit("msd")).unionByName(
        lags.mean_squared_displacement(points.paired_points(own)).withColumn("metric", F.lit("mscd"))
    )
    return schedules.support_census(own, every.where("value is not null"))


def u_curve_census(spark: SparkSession, d: str) -> DataFrame:
    """What became of every attempted curve of all four metrics, with the reason where it has no point."""
    deltas = schedules.delta_family(schedules.matched_delta(points.acquisition_clock(table(spark, d, "frame_table"))))
    found = dense.support_census(frames(spark, d), deltas)
    reason = F.when(F.col("emitted") > 0, "included").when(F.col("below_min_pairs") == F.col("attempted"), "insufficient_valid_pairs_all_lags").otherwise("nonpositive_or_unavailable_normalization")
    return found.withColumns({"included": F.col("emitted") > 0, "reason": reason})


def a_census_hours(spark: SparkSession, d: str) -> DataFrame:
    """Curves per metric, site, hour, inclusion and reason; null groups are kept."""
    hours = frames(spark, d).groupBy("unit_id").agg(F.min("hour").alias("hour"))
    return u_curve_census(spark, d).join(hours, "unit_id").groupBy("metric", "site", "hour", "included", "reason").agg(F.count(F.lit(1)).alias("curves"))


FRAMES = """
with one as (
  select bundle_id as unit_id, frame, min(acquisition_id) as nd2_id, min(cell_id) as crop_id,
    min(case when not isnan(hour_post_delivery) then hour_post_delivery end) as hour,
    arg_min_null(case when site1_valid and isfinite(site1_x_nm) then site1_x_nm / 1000 end, loaded_at) as x1,
    arg_min_null(case when site1_valid and isfinite(site1_y_nm) then site1_y_nm / 1000 end, loaded_at) as y1,
    arg_min_null(case when site2_valid and isfinite(site2_x_nm) then site2_x_nm / 1000 end, loaded_at) as x2,
    arg_min_null(case when site2_valid and isfinite(site2_y_nm) then site2_y_nm / 1000 end, loaded_at) as y2
  from frame_table where bundle_id is not null and frame is not null and site1_valid is not null group by bundle_id, frame),
clock as (
  select acquisition_id as nd2_id, frame, median(micro_time_s) as time_s from frame_table
  where micro_time_s >= 0 and not isnan(micro_time_s) and acquisition_id is not null group by all),
movies as (select nd2_id, max(movie_frames) as movie_frames from acquisition_index group by all),
frames as (
  select unit_id, nd2_id, crop_id, hour, frame, movie_frames, time_s,
    case when y1 is not null then x1 end as x1, case when x1 is not null then y1 end as y1,
    case when y2 is not null then x2 end as x2, case when x2 is not null then y2 end as y2
  from one join movies using (nd2_id) join clock using (nd2_id, frame) where frame between 1 and movie_frames),
sites as (
  select unit_id, nd2_id, movie_frames, frame, time_s, 'site1' as site, x1 as x, y1 as y from frames where x1 is not null
  union all select unit_id, nd2_id, movie_frames, frame, time_s, 'site2', x2, y2 from frames where x2 is not null),
paired as (
  select unit_id, nd2_id, movie_frames, frame, time_s, 'pair' as site, x2 - x1 as x, y2 - y1 as y from frames where x1 is not null and x2 is not null),
velocity as (
  select a.unit_id, a.site, a.nd2_id, a.movie_frames, cast(delta as int) as delta, cast(a.frame as int) as start_frame, cast(b.frame as int) as end_frame, a.time_s as start_s,
    b.time_s - a.time_s as duration_s, (b.x - a.x) / (b.time_s - a.time_s) as vx, (b.y - a.y) / (b.time_s - a.time_s) as vy
  from sites a cross join (select unnest([1, 2, 4]) as delta) join sites b on a.unit_id = b.unit_id and a.site = b.site and b.frame = a.frame + delta
  where b.time_s > a.time_s)
"""
LAST = "least(50, cast(floor(0.25 * a.movie_frames) as int))"


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"case when abs({expr}) between {LARGE!r} and 1e30 then cast(cast({expr} as float) as double) else round({expr} + {TIE!r}, {digits}) + 0.0 end as {name}"


def _msd(source: str) -> str:
    return f"""{FRAMES}, pairs as (
  select a.unit_id, a.site, cast(b.frame - a.frame as int) as lag, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) as sq, b.time_s - a.time_s as dt
  from {source} a join {source} b on a.unit_id = b.unit_id and a.site = b.site and b.frame - a.frame between 1 and {LAST})
select unit_id, site, lag, count(*) as pair_count, {_r("case when count(*) >= 8 then avg(sq) end", "value")}, {_r("case when count(*) >= 8 then stddev_samp(sq) end", "sd")},
  {_r("avg(dt)", "lag_s_mean")}, {_r("median(dt)", "lag_s_median")}, {_r("min(dt)", "lag_s_min")}, {_r("max(dt)", "lag_s_max")}
from pairs group by unit_id, site, lag"""


VELOCITY_SQL = f"""{FRAMES} select unit_id, site, nd2_id, delta, start_frame, end_frame, {_r("start_s", "start_s")}, {_r("duration_s", "duration_s")}, {_r("vx", "vx")}, {_r("vy", "vy")}
from velocity where delta in (1, 4)"""

VAC = f"""{FRAMES}, v as (select * from velocity where delta = 2), raw as (
  select a.unit_id, a.site, a.delta, b.start_frame - a.start_frame as lag, count(*) as pair_count,
    case when count(*) >= 8 then avg(a.vx * b.vx + a.vy * b.vy) end as raw_value, median(b.start_s - a.start_s) as lag_s_median
  from v a join v b on a.unit_id = b.unit_id and a.site = b.site and b.start_frame - a.start_frame between 0 and {LAST} group by all),
energy as (select unit_id, site, delta, avg(vx * vx + vy * vy) as normalization, median(duration_s) as delta_s_median from v group by all),
vac as (select raw.*, normalization, delta_s_median, case when normalization > 0 then raw_value / normalization end as value from raw join energy using (unit_id, site, delta))
"""
VAC_SQL = f"""{VAC} select unit_id, site, delta, lag, pair_count, {", ".join(_r(c, c) for c in ("raw_value", "lag_s_median", "normalization", "delta_s_median", "value"))} from vac"""

VCC = f"""{FRAMES}, v as (select * from velocity where delta = 2), raw as (
  select a.unit_id, a.delta, case when b.site = 'site1' then 'site1_later_vs_site2' else 'site2_later_vs_site1' end as direction, b.start_frame - a.start_frame as lag, count(*) as pair_count,
    avg(b.vx * a.vx) as xx, avg(b.vx * a.vy) as xy, avg(b.vy * a.vx) as yx, avg(b.vy * a.vy) as yy,
    sqrt(avg(a.vx * a.vx + a.vy * a.vy) * avg(b.vx * b.vx + b.vy * b.vy)) as lag_energy, median(b.start_s - a.start_s) as lag_s_median
  from v a join v b on a.unit_id = b.unit_id and a.site <> b.site and b.start_frame - a.start_frame between 0 and {LAST} group by all),
scale as (
  select unit_id, case when count(*) filter (site = 'site1') >= 8 and count(*) filter (site = 'site2') >= 8
    then sqrt(avg(vx * vx + vy * vy) filter (site = 'site1') * avg(vx * vx + vy * vy) filter (site = 'site2')) end as normalization, median(duration_s) as delta_s_median
  from v group by all),
gated as (select * replace (case when pair_count >= 8 then xx end as xx, case when pair_count >= 8 then xy end as xy, case when pair_count >= 8 then yx end as yx, case when pair_count >= 8 then yy end as yy) from raw),
vcc as (select *, xx + yy as raw_value, case when normalization > 0 then (xx + yy) / normalization end as value,
  case when xx is not null and lag_energy > 0 then greatest(-1.0, least(1.0, (xx + yy) / lag_energy)) end as secondary_value from gated join scale using (unit_id)),
comps as (
  select unit_id, delta, direction, lag, pair_count, lag_s_median, normalization, 'x' as row_component, 'x' as column_component, xx as raw_value from vcc where xx is not null
  union all select unit_id, delta, direction, lag, pair_count, lag_s_median, normalization, 'x', 'y', xy from vcc where xx is not null
  union all select unit_id, delta, direction, lag, pair_count, lag_s_median, normalization, 'y', 'x', yx from vcc where xx is not null
  union all select unit_id, delta, direction, lag, pair_count, lag_s_median, normalization, 'y', 'y', yy from vcc where xx is not null),
matrices as (select *, case when normalization > 0 then raw_value / normalization end as normalized_value from comps)
"""
VCC_SQL = f"""{VCC} select unit_id, delta, direction, lag, pair_count, {", ".join(_r(c, c) for c in ("lag_s_median", "raw_value", "normalization", "delta_s_median", "value", "secondary_value"))} from vcc"""
MATRIX_SQL = f"""{VCC} select unit_id, delta, direction, lag, pair_count, row_component, column_component, {", ".join(_r(c, c) for c in ("lag_s_median", "normalization", "raw_value", "normalized_value"))} from matrices"""
SYMMETRIC_SQL = f"""{VCC} select unit_id, delta, lag, {", ".join(_r(f"avg({c})", c) for c in ("value", "raw_value", "lag_s_median"))}, min(pair_count) as pair_count
from vcc where value is not null group by unit_id, delta, lag having count(distinct direction) = 2"""
MATRIX_SYMMETRIC_SQL = f"""{VCC} select unit_id, delta, lag, r as row_component, c as column_component, {_r("avg(raw_value)", "raw_value")}, {_r("avg(normalized_value)", "normalized_value")}, min(pair_count) as pair_count
from (select *, case when direction = 'site2_later_vs_site1' then column_component else row_component end as r, case when direction = 'site2_later_vs_site1' then row_component else column_component end as c from matrices)
group by unit_id, delta, lag, r, c having count(distinct direction) = 2"""

MATRIX_HOURS_SQL = f"""{VCC}, unit as (select unit_id, delta, lag, r, c, avg(raw_value) as raw_value, avg(normalized_value) as normalized_value, min(pair_count) as pair_count
  from (select *, case when direction = 'site2_later_vs_site1' then column_component else row_component end as r, case when direction = 'site2_later_vs_site1' then row_component else column_component end as c from matrices)
  group by unit_id, delta, lag, r, c having count(distinct direction) = 2),
hours as (select unit_id, min(hour) as hour from frames group by unit_id)
select hour, lag, r as row_component, c as column_component, count(*) as n_units, {_r("avg(normalized_value)", "normalized_mean")}, {_r("stddev_samp(normalized_value)", "normalized_sd")}, {_r("avg(raw_value)", "raw_mean")}, {_r("stddev_samp(raw_value)", "raw_sd")}, cast(sum(pair_count) as bigint) as total_pairs
from unit join hours using (unit_id) group by hour, lag, r, c"""
TARGET_V = f"""{FRAMES}, spans as (select a.nd2_id, cast(b.frame - a.frame as int) as delta, median(b.time_s - a.time_s) as delta_s from clock a join clock b on a.nd2_id = b.nd2_id and b.frame > a.frame group by all),
ranked as (select *, row_number() over (partition by nd2_id, target_s order by abs(delta_s - target_s), delta) as place from spans cross join (select unnest([10.0, 20.0, 40.0]::double[]) as target_s)),
family as (select distinct nd2_id, delta from ranked where place = 1 and delta_s between 0.75 * target_s and 1.25 * target_s),
v as (select a.unit_id, a.site, a.movie_frames, f.delta, cast(a.frame as int) as start_frame, a.time_s as start_s, b.time_s - a.time_s as duration_s, (b.x - a.x) / (b.time_s - a.time_s) as vx, (b.y - a.y) / (b.time_s - a.time_s) as vy
  from sites a join family f on a.nd2_id = f.nd2_id join sites b on a.unit_id = b.unit_id and a.site = b.site and b.frame = a.frame + f.delta where b.time_s > a.time_s),
raw as (select a.unit_id, a.delta, a.site as early, b.site as late, b.start_frame - a.start_frame as lag, count(*) as pair_count, case when count(*) >= 8 then avg(a.vx * b.vx + a.vy * b.vy) end as r, median(b.start_s - a.start_s) as lag_s_median
  from v a join v b on a.unit_id = b.unit_id and a.delta = b.delta and b.start_frame - a.start_frame between 0 and least(a.movie_frames - 1, cast(floor(2.5 * a.delta + 1e-12) as int)) group by all),
own as (select unit_id, site, delta, avg(vx * vx + vy * vy) as e, count(*) as n, median(duration_s) as m from v group by all),
twin as (select unit_id, delta, case when count(*) filter (site = 'site1') >= 8 and count(*) filter (site = 'site2') >= 8
  then sqrt(avg(vx * vx + vy * vy) filter (site = 'site1') * avg(vx * vx + vy * vy) filter (site = 'site2')) end as e from v group by unit_id, delta)
"""
VAC_TARGETS_SQL = f"""{TARGET_V} select r.unit_id, early as site, r.delta, lag, pair_count, {_r("r", "raw_value")}, {_r("lag_s_median", "lag_s_median")}, {_r("e", "normalization")}, {_r("m", "delta_s_median")}, {_r("case when e > 0 then r / e end", "value")}
from raw r join own o on r.unit_id = o.unit_id and r.early = o.site and r.delta = o.delta where early = late"""
VCC_TARGETS_SQL = f"""{TARGET_V} select r.unit_id, r.delta, lag, {_r("avg(r / e)", "value")}, {_r("avg(r)", "raw_value")}, {_r("avg(lag_s_median)", "lag_s_median")}, min(pair_count) as pair_count
from raw r join twin o on r.unit_id = o.unit_id and r.delta = o.delta where early <> late and e > 0 and r is not null group by r.unit_id, r.delta, lag having count(distinct late) = 2"""

EXACT_PAIRS = f"""{FRAMES}, wanted as (select s.*, want from sites s cross join (select unnest([5.0, 10.0, 20.0]::double[]) as want)),
near as (
  select a.unit_id, a.site, a.want, a.frame, a.time_s, a.x, a.y, b.frame as b_frame, b.time_s as b_time_s, b.x as b_x, b.y as b_y,
    row_number() over (partition by a.unit_id, a.site, a.want, a.frame order by abs((b.time_s - a.time_s) - a.want), b.time_s, b.frame) as place
  from wanted a join sites b on a.unit_id = b.unit_id and a.site = b.site and b.time_s > a.time_s and b.time_s <= a.time_s + a.want + 0.5
  where abs((b.time_s - a.time_s) - a.want) <= 0.25),
best as (select * from near where place = 1)
"""
EXACT_MSD_SQL = f"""{EXACT_PAIRS} select unit_id, site, want as lag_s, count(*) as pair_count, {_r("case when count(*) >= 8 then avg((b_x - x) * (b_x - x) + (b_y - y) * (b_y - y)) end", "value")} from best group by unit_id, site, want"""
EXACT_VELOCITY = """, ev as (select unit_id, site, cast(frame as int) as start_frame, cast(b_frame as int) as end_frame, time_s as start_s, b_time_s - time_s as duration_s,
  (b_x - x) / (b_time_s - time_s) as vx, (b_y - y) / (b_time_s - time_s) as vy from best where want = 10)"""
EXACT_VELOCITY_SQL = f"""{EXACT_PAIRS}{EXACT_VELOCITY} select unit_id, site, start_frame, end_frame, {", ".join(_r(c, c) for c in ("start_s", "duration_s", "vx", "vy"))} from ev"""


def _exact_correlation(later: str, earlier: str, gate: str) -> str:
    return f"""{EXACT_PAIRS}{EXACT_VELOCITY}, l as (select * from ev where site = '{later}'), e as (select * from ev where site = '{earlier}'),
ways as (
  select e.unit_id, want, e.start_frame, e.vx, e.vy, l.vx as b_vx, l.vy as b_vy,
    row_number() over (partition by e.unit_id, want, e.start_frame order by abs((l.start_s - e.start_s) - want), l.start_s) as place
  from e cross join (select unnest([0.0, 10.0]::double[]) as want) join l on e.unit_id = l.unit_id
  where abs((l.start_s - e.start_s) - want) <= 0.25 and (case when want > 0 then l.start_s > e.start_s else l.start_s >= e.start_s end)),
raw as (select unit_id, want as lag_s, count(*) as pair_count, avg(vx * b_vx + vy * b_vy) as r from ways where place = 1 group by all),
pl as (select unit_id, avg(vx * vx + vy * vy) as e1, count(*) as n1 from l group by all), pe as (select unit_id, avg(vx * vx + vy * vy) as e2, count(*) as n2 from e group by all),
done as (select unit_id, lag_s, pair_count, case when pair_count >= 8 then r end as raw_value, case when {gate} then sqrt(e1 * e2) end as normalization from raw join pl using (unit_id) join pe using (unit_id))
select unit_id, lag_s, pair_count, {_r("raw_value", "raw_value")}, {_r("normalization", "normalization")}, {_r("case when normalization > 0 then raw_value / normalization end", "value")} from done"""


TURNS = f"""{FRAMES}, v as (select * from velocity where delta = 1 and (vx <> 0 or vy <> 0)),
turns as (
  select a.unit_id, a.site, a.delta, a.start_frame, a.end_frame as vertex, b.end_frame,
    acos(greatest(-1.0, least(1.0, (a.vx * b.vx + a.vy * b.vy) / sqrt((a.vx * a.vx + a.vy * a.vy) * (b.vx * b.vx + b.vy * b.vy))))) as angle,
    b.start_s - a.duration_s as from_s, b.start_s + b.duration_s as to_s
  from v a join v b on a.unit_id = b.unit_id and a.site = b.site and b.start_frame = a.end_frame)
"""
TURNS_SQL = f"""{TURNS} select unit_id, site, delta, start_frame, vertex, end_frame, {_r("angle", "angle")}, {_r("from_s", "from_s")}, {_r("to_s", "to_s")} from turns"""
HISTOGRAM_SQL = f"""{TURNS}, counted as (select unit_id, site, cast(least(17, floor(angle / (pi() / 18))) as int) as bin, count(*) as n from turns group by all),
totals as (select unit_id, site, count(*) as total from turns group by all), bins as (select unnest(range(0, 18)) as bin)
select t.unit_id, t.site, cast(b.bin as int) as bin, total, coalesce(n, 0) as n, {_r("coalesce(n, 0) / total", "probability")}
from totals t cross join bins b left join counted c on t.unit_id = c.unit_id and t.site = c.site and b.bin = c.bin"""
PERSISTENCE_SQL = f"""{TURNS}, p as (select unit_id, site, count(*) as turns, avg(case when angle <= radians(30) then 1.0 else 0.0 end) as forward,
  avg(case when angle >= pi() - radians(30) then 1.0 else 0.0 end) as backward from turns group by unit_id, site)
select unit_id, site, turns, {_r("forward", "forward")}, {_r("backward", "backward")}, {_r("forward - backward", "persistence")} from p"""
BURSTS_SQL = f"""{TURNS}, placed as (select *, row_number() over (partition by unit_id, site order by vertex) as place from turns),
near as (select * from placed where angle <= radians(60)),
linked as (select *, case when lag(place) over w = place - 1 and lag(vertex) over w = start_frame then 0 else 1 end as fresh from near window w as (partition by unit_id, site order by place)),
runs as (select *, sum(fresh) over (partition by unit_id, site order by place) as burst from linked)
select unit_id, site, delta, min(start_frame) as first_frame, max(end_frame) as last_frame, count(*) as turns, {_r("max(to_s) - min(from_s)", "duration_s")}, {_r("avg(angle)", "mean_angle")}, {_r("max(angle)", "max_angle")}
from runs group by unit_id, site, delta, burst having count(*) >= 3 and max(to_s) - min(from_s) >= 2.0"""


def _area(source: str, curve: str, positive: bool, cutoff: str) -> str:
    area = (
        """case when value >= 0 and nv >= 0 then (value + nv) * width / 2 when value <= 0 and nv <= 0 then 0
    when value > 0 then value * width * value / (value - nv) / 2 else nv * width * nv / (nv - value) / 2 end"""
        if positive
        else "(value + nv) * width / 2"
    )
    return f"""{source}, flagged as (select *, lag_s_median is not null and value is not null and pair_count >= 8 {cutoff} as ok from {curve}),
linked as (select *, lead(lag_s_median) over w - lag_s_median as width, lead(value) over w as nv, ok and lead(ok) over w and lead(lag) over w = lag + 1 as linked
  from flagged window w as (partition by unit_id, site order by lag)),
sums as (select unit_id, site, count(*) filter (ok) as supported_lags, count(*) filter (linked) as intervals, coalesce(sum(width) filter (linked), 0) as duration,
  sum({area}) filter (linked) as area, count(*) filter (linked and width <= 0) as still from linked group by unit_id, site),
why as (select *, case when supported_lags < 2 then 'fewer_than_two_supported_lags' when still > 0 then 'non_increasing_supported_lag_times' when intervals = 0 then 'no_adjacent_supported_lags'
  when duration < 5 then 'insufficient_supported_duration' end as reason from sums)
select unit_id, site, supported_lags, intervals, {_r("duration", "duration")}, {_r("case when reason is null then area end", "area")}, reason from why"""


MSD_CURVE = f"""{FRAMES}, msd as (
  select a.unit_id, a.site, b.frame - a.frame as lag, count(*) as pair_count, case when count(*) >= 8 then avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) end as value, median(b.time_s - a.time_s) as lag_s_median
  from sites a join sites b on a.unit_id = b.unit_id and a.site = b.site and b.frame - a.frame between 1 and {LAST} group by all)
"""
MODES_SQL = f"""{FRAMES} select unit_id, cast(frame as int) as frame, x1 is not null and x2 is not null as valid, {_r("(x1 + x2) / 2", "common_x")}, {_r("(y1 + y2) / 2", "common_y")},
  {_r("x2 - x1", "relative_x")}, {_r("y2 - y1", "relative_y")}, {_r("sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))", "separation")} from frames"""
ENERGY_SQL = f"""{FRAMES}, e as (select a.unit_id, ((a.vx + b.vx) * (a.vx + b.vx) + (a.vy + b.vy) * (a.vy + b.vy)) / 2 as c, ((a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy)) / 2 as d
  from velocity a join velocity b on a.unit_id = b.unit_id and a.start_frame = b.start_frame and a.delta = 1 and b.delta = 1 and a.site = 'site1' and b.site = 'site2')
select unit_id, {_r("case when sum(c + d) > 0 then sum(c) / sum(c + d) end", "coherent_fraction")} from e group by unit_id"""
SCHEDULE_SQL = """
with per as (select acquisition_id as nd2_id, frame, min(micro_time_s) as low, median(micro_time_s) as t, max(micro_time_s) as high from frame_table where micro_time_s >= 0 and not isnan(micro_time_s) group by all),
checked as (select *, high - low > 1e-9 * greatest(1.0, abs(t)) as conflict, t <= lag(t) over (partition by nd2_id order by frame) as back from per),
found as (select nd2_id, count(*) as seen, count(*) filter (conflict) as c, count(*) filter (back) as b from checked group by all)
select m.nd2_id, movie_frames, coalesce(seen, 0) as frames_seen, coalesce(c, 0) as conflicting, coalesce(b, 0) as not_increasing, movie_frames - coalesce(seen, 0) as absent
from (select nd2_id, max(movie_frames) as movie_frames from acquisition_index group by all) m left join found f on m.nd2_id = f.nd2_id"""
DELTA_SQL = f"""{FRAMES}, spans as (select a.nd2_id, cast(b.frame - a.frame as int) as delta, median(b.time_s - a.time_s) as delta_s from clock a join clock b on a.nd2_id = b.nd2_id and b.frame > a.frame group by all),
ranked as (select *, row_number() over (partition by nd2_id, target_s order by abs(delta_s - target_s), delta) as place from spans cross join (select unnest([10.0, 20.0, 40.0]::double[]) as target_s))
select nd2_id, target_s, case when delta_s between 0.75 * target_s and 1.25 * target_s then delta end as delta, {_r("delta_s", "delta_s")} from ranked where place = 1"""

UNIT_CURVES = f"""{FRAMES}, spans as (select a.nd2_id, cast(b.frame - a.frame as int) as delta, median(b.time_s - a.time_s) as delta_s from clock a join clock b on a.nd2_id = b.nd2_id and b.frame > a.frame group by all),
ranked as (select *, row_number() over (partition by nd2_id order by abs(delta_s - 10), delta) as place from spans),
matched as (select nd2_id, case when delta_s between 7.5 and 12.5 then delta end as delta from ranked where place = 1),
family as (select distinct nd2_id, unnest(case when delta is null then [1, 2, 4, 8] else [1, 2, 4, 8, delta] end) as delta from matched),
every as (select * from sites union all select * from paired),
moved as (select a.unit_id, a.site, cast(b.frame - a.frame as int) as lag, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) as sq, b.time_s - a.time_s as dt
  from every a join every b on a.unit_id = b.unit_id and a.site = b.site and b.frame - a.frame between 1 and {LAST}),
msd as (select case when site = 'pair' then 'mscd' else 'msd' end as metric, unit_id, site, cast(null as varchar) as direction, cast(null as int) as delta, lag, median(dt) as lag_s_median, cast(null as double) as delta_s_median,
  avg(sq) as value, avg(sq) as raw_value, stddev_samp(sq) as sd, count(*) as pair_count, cast(null as double) as normalization from moved group by unit_id, site, lag having count(*) >= 8),
v as (select a.unit_id, a.site, a.movie_frames, f.delta, cast(a.frame as int) as start_frame, a.time_s as start_s, b.time_s - a.time_s as duration_s, (b.x - a.x) / (b.time_s - a.time_s) as vx, (b.y - a.y) / (b.time_s - a.time_s) as vy
  from sites a join family f on a.nd2_id = f.nd2_id join sites b on a.unit_id = b.unit_id and a.site = b.site and b.frame = a.frame + f.delta where b.time_s > a.time_s),
own as (select unit_id, site, delta, avg(vx * vx + vy * vy) as e, count(*) as n, median(duration_s) as m from v group by all),
twin as (select unit_id, delta, median(duration_s) as m, case when count(*) filter (site = 'site1') >= 8 and count(*) filter (site = 'site2') >= 8
  then sqrt(avg(vx * vx + vy * vy) filter (site = 'site1') * avg(vx * vx + vy * vy) filter (site = 'site2')) end as e from v group by unit_id, delta),
raw as (select a.unit_id, a.delta, a.site as early, b.site as late, b.start_frame - a.start_frame as lag, median(b.start_s - a.start_s) as lag_s_median, avg(a.vx * b.vx + a.vy * b.vy) as r, count(*) as pair_count
  from v a join v b on a.unit_id = b.unit_id and a.delta = b.delta and b.start_frame - a.start_frame between 0 and {LAST} group by all having count(*) >= 8),
vac as (select 'vac' as metric, r.unit_id, early as site, cast(null as varchar) as direction, r.delta, lag, lag_s_median, m as delta_s_median, r / e as value, r as raw_value, cast(null as double) as sd, pair_count, e as normalization
  from raw r join own o on r.unit_id = o.unit_id and r.early = o.site and r.delta = o.delta where early = late and e > 0),
vcc as (select 'vcc' as metric, r.unit_id, cast(null as varchar) as site, case when late = 'site1' then 'site1_later_vs_site2' else 'site2_later_vs_site1' end as direction, r.delta, lag, lag_s_median, m as delta_s_median, r / e as value, r as raw_value,
  cast(null as double) as sd, pair_count, e as normalization from raw r join twin o on r.unit_id = o.unit_id and r.delta = o.delta where early <> late and e > 0),
curves as (select * from msd union all select * from vac union all select * from vcc),
ids as (select unit_id, min(nd2_id) as nd2_id, min(crop_id) as crop_id, min(hour) as hour from frames group by unit_id)
"""
UNIT_CURVES_SQL = f"""{UNIT_CURVES}
select metric, c.unit_id, site, direction, c.delta, lag, {", ".join(_r(x, x) for x in ("lag_s_median", "delta_s_median", "value", "raw_value", "sd"))}, pair_count, {_r("normalization", "normalization")},
  ids.nd2_id, crop_id, {_r("hour", "hour")}, m.delta is not null as is_primary
from curves c join ids using (unit_id) left join matched m on ids.nd2_id = m.nd2_id and c.delta = m.delta"""

CENSUS = f"""{UNIT_CURVES}, pairs as (
  select a.unit_id, a.delta, a.site as early, b.site as late, b.start_frame - a.start_frame as lag, count(*) as n from v a join v b on a.unit_id = b.unit_id and a.delta = b.delta and b.start_frame - a.start_frame between 0 and {LAST} group by all),
steps as (select unit_id, site, lag, count(*) as n from moved group by all),
units as (select unit_id, min(nd2_id) as nd2_id, max(movie_frames) as movie_frames from frames group by unit_id),
tried as (
  select case when site = 'pair' then 'mscd' else 'msd' end as metric, unit_id, site, site as early, site as late, cast(null as varchar) as direction, cast(null as int) as delta, unnest(range(1, cast(least(50, floor(0.25 * movie_frames)) as int) + 1)) as lag
  from units cross join (select unnest(['site1', 'site2', 'pair']) as site)
  union all
  select case when early = late then 'vac' else 'vcc' end, unit_id, case when early = late then early end, early, late, case when early <> late then late || '_later_vs_' || early end, delta,
    unnest(range(0, cast(least(50, floor(0.25 * movie_frames), movie_frames - delta - 1) as int) + 1))
  from units join family using (nd2_id) cross join (select unnest(['site1', 'site2']) as early) cross join (select unnest(['site1', 'site2']) as late) where delta < movie_frames),
lagged as (
  select t.*, coalesce(s.n, p.n, 0) as n, coalesce(s.n, p.n, 0) >= 8 and case t.metric when 'vac' then coalesce(o.e > 0, false) when 'vcc' then coalesce(w.e > 0, false) else true end as ok
  from tried t left join steps s on t.delta is null and t.unit_id = s.unit_id and t.site = s.site and t.lag = s.lag left join pairs p on t.delta = p.delta and t.unit_id = p.unit_id and t.early = p.early and t.late = p.late and t.lag = p.lag
  left join own o on t.unit_id = o.unit_id and t.delta = o.delta and t.site = o.site left join twin w on t.unit_id = w.unit_id and t.delta = w.delta),
counted as (select metric, unit_id, site, direction, delta, count(*) as attempted, count(*) filter (ok) as emitted, count(*) filter (n < 8) as below_min_pairs, count(*) filter (n >= 8 and not ok) as invalid, cast(max(n) as bigint) as most_pairs
  from lagged group by metric, unit_id, site, direction, delta),
census as (select *, emitted > 0 as included, case when emitted > 0 then 'included' when below_min_pairs = attempted then 'insufficient_valid_pairs_all_lags' else 'nonpositive_or_unavailable_normalization' end as reason from counted)
"""

QUERIES = {f.__name__: f for f in (
    k_msd, k_mscd, k_velocity, k_vac, k_vcc, k_vcc_matrix, k_vcc_symmetric, k_matrix_symmetric, a_matrix_hours, k_vac_targets, k_vcc_targets, k_msd_exact_time, k_velocity_exact_time, k_vcc_exact_time, k_vac_exact_time, k_turning_exact_time,
    k_turning, k_direction_histogram, k_turning_persistence, k_persistence_null, k_directed_bursts, k_positive_area, k_curve_area, k_pair_modes, k_motion_energy,
    u_schedule, u_matched_delta, u_unit_curves, u_support_census, u_curve_census, a_census_hours, k_mscd_exact_time,
)}
ORACLES = {n: named_sql(sql) for n, sql in {
    "k_msd": _msd("sites"),
    "k_mscd": _msd("paired"),
    "k_velocity": VELOCITY_SQL,
    "k_vac": VAC_SQL,
    "k_vcc": VCC_SQL,
    "k_vcc_matrix": MATRIX_SQL,
    "k_vcc_symmetric": SYMMETRIC_SQL,
    "k_matrix_symmetric": MATRIX_SYMMETRIC_SQL,
    "k_msd_exact_time": EXACT_MSD_SQL,
    "k_velocity_exact_time": EXACT_VELOCITY_SQL,
    "k_vcc_exact_time": _exact_correlation("site1", "site2", "n1 >= 8 and n2 >= 8"),
    "k_vac_exact_time": _exact_correlation("site1", "site1", "true"),
    "k_turning_exact_time": f"""{EXACT_PAIRS}{EXACT_VELOCITY}, m as (select * from ev where vx <> 0 or vy <> 0)
select a.unit_id, a.site, a.start_frame, a.end_frame as vertex, b.end_frame, {_r("acos(greatest(-1.0, least(1.0, (a.vx * b.vx + a.vy * b.vy) / sqrt((a.vx * a.vx + a.vy * a.vy) * (b.vx * b.vx + b.vy * b.vy)))))", "angle")},
  {_r("b.start_s - a.duration_s", "from_s")}, {_r("b.start_s + b.duration_s", "to_s")} from m a join m b on a.unit_id = b.unit_id and a.site = b.site and b.start_frame = a.end_frame""",
    "k_turning": TURNS_SQL,
    "k_direction_histogram": HISTOGRAM_SQL,
    "k_turning_persistence": PERSISTENCE_SQL,
    "k_directed_bursts": BURSTS_SQL,
    "k_positive_area": _area(VAC, "vac", True, "and lag_s_median <= 60"),
    "k_curve_area": _area(MSD_CURVE, "msd", False, ""),
    "k_pair_modes": MODES_SQL,
    "k_motion_energy": ENERGY_SQL,
    "u_schedule": SCHEDULE_SQL,
    "u_matched_delta": DELTA_SQL,
    "u_unit_curves": UNIT_CURVES_SQL,
    "k_mscd_exact_time": FRAMES + EXACT_MSD_SQL[len(FRAMES) :].replace("from sites s cross", "from paired s cross").replace("join sites b", "join paired b"),
    "u_curve_census": f"{CENSUS} select * from census",
    "a_census_hours": f"{CENSUS} select metric, site, hour, included, reason, count(*) as curves from census join ids using (unit_id) group by metric, site, hour, included, reason",
    "a_matrix_hours": MATRIX_HOURS_SQL,
    "k_vac_targets": VAC_TARGETS_SQL,
    "k_vcc_targets": VCC_TARGETS_SQL,
    "u_support_census": f"""{FRAMES}, seen as (select unit_id, max(movie_frames) as movie_frames, count(x1) as s1, count(x2) as s2, count(*) filter (x1 is not null and x2 is not null) as sp from frames group by all),
grid as (select unit_id, movie_frames, 'msd' as metric, 'site1' as site, s1 as observed from seen union all select unit_id, movie_frames, 'msd', 'site2', s2 from seen union all select unit_id, movie_frames, 'mscd', 'pair', sp from seen),
every as (select * from sites union all select * from paired),
counted as (select a.unit_id, a.site, b.frame - a.frame as lag, count(*) as n from every a join every b on a.unit_id = b.unit_id and a.site = b.site and b.frame - a.frame between 1 and {LAST} group by all),
got as (select unit_id, site, count(*) as k, max(n) as m from counted where n >= 8 group by all),
done as (select g.unit_id, metric, g.site, cast(movie_frames as int) as movie_frames, cast(least(50, floor(0.25 * movie_frames)) as int) as max_lag, observed, coalesce(k, 0) as supported_lags, m as most_pairs,
  case when floor(0.25 * movie_frames) < 1 then 'movie_too_short' when observed = 0 then 'no_observations' when k is null then 'insufficient_valid_pairs_all_lags' end as reason
  from grid g left join got on g.unit_id = got.unit_id and g.site = got.site)
select *, reason is null as included from done""",
}.items()}
