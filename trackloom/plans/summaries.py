"""Queries over the unit curves, with DuckDB SQL that restates each of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.numeric import bin_edges
from trackloom.operators import cube, curves, dense, lags, points, resampling, schedules
from trackloom.plans.kernels import TARGET_V, TARGETS, UNIT_CURVES, VCC, _r, _round, computed_curves, frames as bundle_frames
from trackloom.session import written
from trackloom.sources.tables import named_sql, named_table as table

SCALED = tuple(i * 0.25 for i in range(0, 21))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return curves.clean_curves(table(spark, d, "unit_curves"))


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return curves.unit_bins(_clean(spark, d))


def n_unit_bins(spark: SparkSession, d: str) -> DataFrame:
    return _round(_bins(spark, d))


def a_hour_curves(spark: SparkSession, d: str) -> DataFrame:
    return _round(curves.hour_curves(written(_bins(spark, d))))


def _vac(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).where("metric = 'vac'")


def n_scaled_bins(spark: SparkSession, d: str) -> DataFrame:
    keep = ["hour_post_delivery", "site", "unit_id", "delta_median_s", "center", "lag_frames", "value", "pair_count"]
    return _round(curves.scaled_bins(_vac(spark, d), SCALED).select(*keep))


def a_delta_curves(spark: SparkSession, d: str) -> DataFrame:
    one = curves.scaled_bins(_vac(spark, d), SCALED)
    return _round(
        one.groupBy("hour_post_delivery", "site", "center").agg(
            F.avg("scaled_lag_tau_over_delta").alias("x_mean"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"),
            F.count_distinct("unit_id").alias("n_units"), F.count_distinct("crop_id").alias("n_crops"), F.sum("pair_count").alias("total_pairs"),
            F.avg("delta_median_s").alias("delta_s_mean"), F.min("delta_median_s").alias("delta_s_min"), F.max("delta_median_s").alias("delta_s_max"),
        )
    )


def a_collapsed_curves(spark: SparkSession, d: str) -> DataFrame:
    return _round(curves.collapsed_curves(curves.scaled_bins(_vac(spark, d), SCALED)))


def n_fine_grid(spark: SparkSession, d: str) -> DataFrame:
    return _round(curves.fine_curve(_vac(spark, d)))


def _hour_points(spark: SparkSession, d: str) -> DataFrame:
    return curves.hour_curves(written(_bins(spark, d))).where("hour_post_delivery is not null")


def f_power_fits(spark: SparkSession, d: str) -> DataFrame:
    own = _hour_points(spark, d).where("metric in ('msd', 'mscd') and lag_s_mean between 1 and 50").withColumn("site", F.coalesce("site", F.lit("pair")))
    return _round(curves.power_fits(own, ["metric", "site", "hour_post_delivery"], "lag_s_mean", "mean", "n_units"), 5)


def f_trajectory_fits(spark: SparkSession, d: str) -> DataFrame:
    return _round(curves.trajectory_fits(_clean(spark, d).where("metric = 'msd'"), 1.0, 50.0), 5)


def _fits(spark: SparkSession, d: str) -> DataFrame:
    return _round(curves.trajectory_fits(_clean(spark, d).where("metric = 'msd'"), 1.0, 50.0), 5)


def t_alpha_extremes(spark: SparkSession, d: str) -> DataFrame:
    keep = ["unit_id", "bundle_id", "site", "alpha", "r2_log", "fit_endpoint_pairs", "class", "rank"]
    return curves.extremes(_fits(spark, d), 10, "alpha", "unit_id").select(*keep)


def t_alpha_cases(spark: SparkSession, d: str) -> DataFrame:
    return curves.nearest_cases(_fits(spark, d), [0.25, 0.5, 0.75, 1.0])


def t_site_ranks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    up, down = Window.partitionBy("site").orderBy("alpha", "unit_id"), Window.partitionBy("site").orderBy(F.desc("alpha"), "unit_id")
    both = _fits(spark, d).withColumns({"low_rank": F.row_number().over(up), "high_rank": F.row_number().over(down)})
    return both.where("low_rank <= 10 or high_rank <= 10").select("site", "unit_id", "alpha", "low_rank", "high_rank")


def t_near_lag(spark: SparkSession, d: str) -> DataFrame:
    return _round(curves.near_lag_ranking(_clean(spark, d).where("metric = 'mscd'")))


def _alphas(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d).where("hour_post_delivery is not null").groupBy("site", "hour_post_delivery").agg(F.avg("alpha").alias("alpha"))


def _vac_points(spark: SparkSession, d: str) -> DataFrame:
    own = curves.collapsed_curves(curves.scaled_bins(_vac(spark, d), SCALED)).where("hour_post_delivery is not null and center > 0 and center <= 5")
    return own.select("site", "hour_post_delivery", F.col("center").alias("x"), F.col("mean").alias("value"), F.col("n_units").cast("double").alias("weight"))


def f_vac_consistency(spark: SparkSession, d: str) -> DataFrame:
    return _round(curves.fbm_rmse(_vac_points(spark, d), _alphas(spark, d), ["site", "hour_post_delivery"]), 5)


def t_best_worst_hour(spark: SparkSession, d: str) -> DataFrame:
    found = f_vac_consistency(spark, d).groupBy("hour_post_delivery").agg(F.avg("rmse").alias("rmse"), F.count_distinct("site").alias("sites")).where("sites = 2")
    return found.agg(F.min_by("hour_post_delivery", "rmse").alias("best_hour"), F.max_by("hour_post_delivery", "rmse").alias("worst_hour"))


def f_hour_trend(spark: SparkSession, d: str) -> DataFrame:
    return _round(curves.hour_trend(f_power_fits(spark, d), ["metric", "site"], "hour_post_delivery", "exponent"))


def f_zero_crossing(spark: SparkSession, d: str) -> DataFrame:
    own = curves.collapsed_curves(curves.scaled_bins(_vac(spark, d), SCALED)).where("hour_post_delivery is not null")
    return _round(curves.zero_crossing(own, ["site", "hour_post_delivery"], "center", "mean"), 5)


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    """From the computed curves: the delivered table has no bundle with both directions at its primary offset."""
    return curves.correlation_endpoints(curves.unit_bins(computed_curves(spark, d).where("metric = 'vcc'"))).where("hour_post_delivery is not null")


def f_vcc_endpoints(spark: SparkSession, d: str) -> DataFrame:
    own = _endpoints(spark, d)
    per = own.groupBy("hour_post_delivery", "endpoint").agg(F.avg("value").alias("estimate"), F.count_distinct("unit_id").alias("n_units"), F.count_distinct("crop_id").alias("n_crops"))
    return _round(per)


def f_vcc_endpoint_intervals(spark: SparkSession, d: str) -> DataFrame:
    return resampling.bootstrap_means(_endpoints(spark, d), ["hour_post_delivery", "endpoint"], "crop_id", "value", 500)


def f_window_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each hour's fitted curve over log time from 1 to 50 s, refitted for resampled crops."""
    return resampling.bootstrap_window_means(_bins(spark, d).where("metric = 'msd' and hour_post_delivery is not null"), ["site", "hour_post_delivery"], "crop_id", 1.0, 50.0, 500)


def f_fbm_fits(spark: SparkSession, d: str) -> DataFrame:
    return resampling.fit_fbm(_vac_points(spark, d), ["site", "hour_post_delivery"], weighted=True)


def f_fbm_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    own = curves.scaled_bins(_vac(spark, d), SCALED).where("hour_post_delivery is not null").withColumn("x", F.col("center"))
    return resampling.bootstrap_fbm(own, ["site", "hour_post_delivery"], "crop_id", "unit_id", iterations=300)


def f_bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    own = _bins(spark, d).where("hour_post_delivery is not null and metric in ('msd', 'mscd')").withColumn("site", F.coalesce("site", F.lit("pair")))
    return resampling.bootstrap_means(own, ["metric", "site", "hour_post_delivery", "bin_s"], "crop_id", "value", 500)


def f_bootstrap_exponents(spark: SparkSession, d: str) -> DataFrame:
    """A statistic given as a Python function: the log-log slope over bin centers of resampled crops' mean curve."""

    def slope(pdf) -> float:
        mean = pdf.groupby("bin_s")[["total", "n"]].sum()
        y = mean.total / mean.n
        ok = (y > 0) & (y.index > 0)
        return float(np.polyfit(np.log(y.index[ok].to_numpy()), np.log(y[ok].to_numpy()), 1)[0]) if ok.sum() >= 2 else float("nan")

    own = _bins(spark, d).where("hour_post_delivery is not null and metric = 'msd' and bin_s between 1 and 50")
    sums = resampling.cluster_sums(own, ["site", "hour_post_delivery"], "crop_id", "value", "bin_s")
    return resampling.cluster_bootstrap(sums, ["site", "hour_post_delivery"], "crop_id", slope, 500, columns=["bin_s", "total", "n"])


def _vcc_units(spark: SparkSession, d: str) -> DataFrame:
    """One symmetric cross-correlation per unit, target duration and scaled-lag center, from the frames: each
    acquisition's offset nearest to the target, directions averaged where both exist, the nearest lag of each center."""
    rows = table(spark, d, "frame_table")
    clock = written(points.acquisition_clock(rows))
    own = written(points.bundle_frames(rows, table(spark, d, "acquisition_index"), clock))
    matched = written(schedules.matched_delta(clock, TARGETS).where("delta is not null").select("nd2_id", "delta", "target_s"))
    both = dense.symmetric_cross_correlation(own, matched, SCALED[:11])
    ids = own.groupBy("unit_id").agg(*[F.min(c).alias(c) for c in lags.IDENTITY])
    named = both.join(ids, "unit_id").join(F.broadcast(matched), ["nd2_id", "delta"]).where("hour is not null")  # one row per acquisition and target
    return named.select("unit_id", "crop_id", F.col("hour").alias("hour_post_delivery"), "target_s", "value", F.col("delta_s_median").alias("delta_s"), "pair_count", F.col("lag").alias("lag_frames"), (F.col("lag") / F.col("delta")).alias("scaled_lag_tau_over_delta"), "center")


def a_vcc_hour_curves(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric cross-correlation per hour, target duration and scaled lag, every unit with equal weight."""
    return _round(
        _vcc_units(spark, d).groupBy("hour_post_delivery", "target_s", "center").agg(
            F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"), F.count_distinct("unit_id").alias("n_units"), F.count_distinct("crop_id").alias("n_crops"), F.avg("delta_s").alias("delta_s"),
        ), 5,
    )


def a_matrix_bins(spark: SparkSession, d: str) -> DataFrame:
    """Hour mean and SD of the symmetrised matrices of each acquisition's matched 10 s offset, on the lag bins."""
    own = written(bundle_frames(spark, d))
    deltas = schedules.matched_delta(points.acquisition_clock(table(spark, d, "frame_table"))).where("delta is not null").select("nd2_id", "delta")
    vcc = lags.velocity_cross_correlation(written(lags.velocities(points.site_points(own), written(deltas))))
    unit = curves.matrix_bins(lags.transpose_reverse(lags.matrix_rows(vcc)))
    ids = own.groupBy("unit_id").agg(*[F.min(c).alias(c) for c in lags.IDENTITY])
    value = lambda c, n: [F.avg(c).alias(f"{n}_mean"), F.stddev_samp(c).alias(f"{n}_sd")]
    return _round(
        unit.join(ids, "unit_id").groupBy("hour", "row_component", "column_component", "bin_s").agg(
            F.avg("lag_s_median").alias("lag_s_mean"), *value("normalized_value", "normalized"), *value("raw_value", "raw"),
            F.count_distinct("unit_id").alias("n_units"), F.count_distinct("crop_id").alias("n_crops"), F.count_distinct("nd2_id").alias("n_acquisitions"), F.sum("pair_count").alias("total_pairs"),
        ), 5,
    )


def _cube() -> cube.Cube:
    alphas, ratios, lag = np.linspace(0.25, 1.0, 4), np.linspace(-3, 3, 13), np.linspace(0, 5, 21)
    a, r, x = np.meshgrid(alphas, ratios, lag, indexing="ij")
    return cube.Cube(alphas, ratios, lag, resampling.fbm(x, a) / (1 + 10.0**-r))


def f_tau_grid(spark: SparkSession, d: str) -> DataFrame:
    """Communication time of each hour's symmetric cross-correlation against a reference cube. The measured cube
    is not published with the data, so the cube here is the fBM curve damped by the ratio of tau and delta."""
    units = _vcc_units(spark, d)
    points = units.groupBy("hour_post_delivery", "target_s", "center").agg(F.avg("value").alias("value"), F.avg("delta_s").alias("delta_s"), F.count_distinct("unit_id").alias("units"))
    return cube.tau_search(points, _cube(), alpha=0.5)


def f_tau_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return cube.tau_bootstrap(_vcc_units(spark, d), _cube(), 0.5, "crop_id", 200)


CLEAN = """
with ok as (
  select * replace (case when not isnan(hour_post_delivery) then hour_post_delivery end as hour_post_delivery, case when not isnan(delta_median_s) then delta_median_s end as delta_median_s,
    case when not isnan(lag_median_s) then lag_median_s end as lag_median_s, case when not isnan(scaled_lag_tau_over_delta) then scaled_lag_tau_over_delta end as scaled_lag_tau_over_delta,
    case when not isnan(raw_value) then raw_value end as raw_value, case when not isnan(endpoint_pair_sd) then endpoint_pair_sd end as endpoint_pair_sd, case when not isnan(normalization) then normalization end as normalization)
  from unit_curves where value is not null and isfinite(value)),
ranked as (select *, row_number() over (partition by metric, unit_id, lag_frames, site, direction, delta_median_s order by value, pair_count nulls first, bundle_id nulls first, nd2_id nulls first, crop_id nulls first, hour_post_delivery nulls first,
  is_primary_matched_10s nulls first, lag_median_s nulls first, scaled_lag_tau_over_delta nulls first, raw_value nulls first, endpoint_pair_sd nulls first, normalization nulls first) as place from ok),
clean as (select * exclude (place) from ranked where place = 1)
"""


def _bin_case() -> str:
    edges = bin_edges(curves.CENTERS_S)
    return "case when abs(lag_median_s) <= 1e-12 then 0.0 " + " ".join(
        f"when lag_median_s >= {a!r} and lag_median_s < {b!r} then {c!r}" for c, a, b in zip(curves.CENTERS_S, edges, edges[1:])
    ) + " end"


BINS = f"""{CLEAN}, binned as (select *, cast({_bin_case()} as double) as bin_s from clean where metric in ('msd', 'mscd') or (metric in ('vac', 'vcc') and is_primary_matched_10s)),
placed as (select *, row_number() over (partition by metric, unit_id, hour_post_delivery, site, direction, bin_s
  order by round(case when bin_s > 0 then abs(ln(lag_median_s / bin_s)) else 0 end, 12), pair_count desc nulls last, lag_frames) as place from binned where bin_s is not null),
chosen as (select * from placed where place = 1),
bins as (
  select metric, unit_id, bundle_id, nd2_id, crop_id, hour_post_delivery, site, bin_s, lag_median_s, scaled_lag_tau_over_delta, delta_median_s, value, endpoint_pair_sd, pair_count, lag_frames from chosen where metric <> 'vcc'
  union all select metric, coalesce(bundle_id, unit_id), bundle_id, nd2_id, crop_id, hour_post_delivery, site, bin_s, avg(lag_median_s), avg(scaled_lag_tau_over_delta), avg(delta_median_s), avg(value), avg(endpoint_pair_sd), min(pair_count), min(lag_frames)
  from chosen where metric = 'vcc' group by metric, coalesce(bundle_id, unit_id), bundle_id, nd2_id, crop_id, hour_post_delivery, site, bin_s having count(distinct direction) = 2)
"""
HOURS = f"""{BINS}, available as (select metric, site, hour_post_delivery, count(distinct unit_id) as available_units from bins where hour_post_delivery is not null group by all),
per as (select metric, site, hour_post_delivery, bin_s, avg(lag_median_s) as lag_s_mean, avg(value) as mean, stddev_samp(value) as sd, median(value) as median, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.75) as q75,
  count(distinct unit_id) as n_units, count(distinct crop_id) as n_crops, count(distinct nd2_id) as n_acquisitions, cast(sum(pair_count) as bigint) as total_pairs from bins group by metric, site, hour_post_delivery, bin_s),
hours as (select p.*, available_units, n_units / available_units as retained_unit_fraction from per p left join available a
  on p.metric is not distinct from a.metric and p.site is not distinct from a.site and p.hour_post_delivery is not distinct from a.hour_post_delivery)
"""
_list = f"[{', '.join(map(str, SCALED))}]::double[]"
SCALED_BINS = f"""{CLEAN}, near as (select v.*, c.center, row_number() over (partition by unit_id, lag_frames, site, direction, delta_median_s order by abs(scaled_lag_tau_over_delta - c.center), c.center) as k
  from clean v cross join (select unnest({_list}) as center) c where metric = 'vac' and scaled_lag_tau_over_delta is not null),
scaled as (select * from (select * exclude (k), row_number() over (partition by hour_post_delivery, site, unit_id, delta_median_s, center order by round(abs(scaled_lag_tau_over_delta - center), 12), pair_count desc nulls last, lag_frames) as place from near where k = 1) where place = 1),
unit as (select hour_post_delivery, site, unit_id, center, avg(value) as value, sum(pair_count) as pair_count from scaled group by all),
collapsed as (select hour_post_delivery, site, center, avg(value) as mean, stddev_samp(value) as sd, count(*) as n_units, cast(sum(pair_count) as bigint) as total_pairs from unit group by all)
"""
FITS = f"""{CLEAN}, p as (select unit_id, bundle_id, nd2_id, crop_id, hour_post_delivery, site, lag_median_s, log10(lag_median_s) as x, log10(value) as y, cast(pair_count as double) as w
  from clean where metric = 'msd' and lag_median_s >= 1 and lag_median_s <= 50 and value > 0 and pair_count >= 8),
s as (select unit_id, bundle_id, nd2_id, crop_id, hour_post_delivery, site, count(*) as n_fit_lags, min(lag_median_s) as fit_lag_min_s, max(lag_median_s) as fit_lag_max_s, cast(sum(w) as bigint) as fit_endpoint_pairs,
  sum(w) as w, sum(w * x) as wx, sum(w * y) as wy, sum(w * x * x) as wxx, sum(w * x * y) as wxy, sum(w * y * y) as wyy from p group by unit_id, bundle_id, nd2_id, crop_id, hour_post_delivery, site),
a as (select *, case when w * wxx - wx * wx > 0 then (w * wxy - wx * wy) / (w * wxx - wx * wx) end as alpha from s where n_fit_lags >= 5 and fit_lag_max_s / fit_lag_min_s >= 4),
c as (select *, (wy - alpha * wx) / w as c from a),
fits as (select unit_id, bundle_id, nd2_id, crop_id, hour_post_delivery, site, {_r("alpha", "alpha", 5)}, {_r("pow(10.0, c)", "amplitude_at_1s", 5)},
  {_r("1 - case when wyy - wy * wy / w > 0 then (wyy - 2 * c * wy - 2 * alpha * wxy + c * c * w + 2 * c * alpha * wx + alpha * alpha * wxx) / (wyy - wy * wy / w) end", "r2_log", 5)},
  n_fit_lags, {_r("fit_lag_min_s", "fit_lag_min_s", 5)}, {_r("fit_lag_max_s", "fit_lag_max_s", 5)}, fit_endpoint_pairs,
  {_r("case when abs(alpha) < 1e-12 then pow(10.0, c) else pow(10.0, c) * (pow(50.0, alpha) - 1) / (alpha * ln(50.0)) end", "window_mean", 5)} from c)
"""
POWER = f"""{HOURS}, pp as (select metric, coalesce(site, 'pair') as site, hour_post_delivery, lag_s_mean as x0, ln(lag_s_mean) as lx, ln(mean) as ly, cast(n_units as double) as w, sqrt(n_units) as r
  from hours where hour_post_delivery is not null and metric in ('msd', 'mscd') and lag_s_mean between 1 and 50 and mean > 0),
ps as (select metric, site, hour_post_delivery, count(*) as points, max(x0) / min(x0) as span, sum(w) as w, sum(w * lx) as wx, sum(w * ly) as wy, sum(w * lx * lx) as wxx, sum(w * lx * ly) as wxy,
  sum(r) as r, sum(r * lx) as rx, sum(r * ly) as ry, sum(r * lx * lx) as rxx, sum(r * lx * ly) as rxy, sum(r * ly * ly) as ryy from pp group by metric, site, hour_post_delivery having count(*) >= 2),
pe as (select *, case when w * wxx - wx * wx > 0 then (w * wxy - wx * wy) / (w * wxx - wx * wx) end as e from ps),
pc as (select *, (wy - e * wx) / w as c from pe),
power as (select metric, site, hour_post_delivery, points, {_r("span", "span", 5)}, {_r("e", "exponent", 5)}, {_r("exp(c)", "amplitude_at_1s", 5)}, {_r("exp(c) * pow(10.0, e)", "value_at_10s", 5)},
  {_r("1 - case when ryy - ry * ry / r > 0 then (ryy - 2 * c * ry - 2 * e * rxy + c * c * r + 2 * c * e * rx + e * e * rxx) / (ryy - ry * ry / r) end", "r2_log", 5)} from pc)
"""
RMSE = f"""{FITS}, {SCALED_BINS.split("clean as (select * exclude (place) from ranked where place = 1)")[1].lstrip().lstrip(",").strip()},
alphas as (select site, hour_post_delivery, avg(alpha) as alpha from fits where hour_post_delivery is not null group by all),
rmse as (select k.site, k.hour_post_delivery, {_r("sqrt(sum(n_units * pow(mean - (pow(abs(center - 1), alpha) + pow(abs(center + 1), alpha) - 2 * pow(center, alpha)) / 2, 2)) / sum(n_units))", "rmse", 5)}, count(*) as points
  from collapsed k join alphas a on k.site = a.site and k.hour_post_delivery = a.hour_post_delivery where center > 0 and center <= 5 group by k.site, k.hour_post_delivery)
"""
_six = lambda *c: ", ".join(_r(x, x) for x in c)

VCC_UNITS = f"""{TARGET_V}, vtwin as (select o.*, m from twin o join (select unit_id, delta, median(duration_s) as m from v group by all) using (unit_id, delta)),
vboth as (select r.unit_id, r.delta, lag, avg(r / e) as value, min(pair_count) as pair_count, any_value(m) as delta_s from raw r join vtwin o on r.unit_id = o.unit_id and r.delta = o.delta where early <> late and e > 0 and r is not null
  group by r.unit_id, r.delta, lag having count(distinct late) = 2),
vids as (select unit_id, min(nd2_id) as nd2_id, min(crop_id) as crop_id, min(hour) as hour_post_delivery from frames group by unit_id),
vnamed as (select b.*, crop_id, hour_post_delivery, target_s, lag / b.delta as x from vboth b join vids using (unit_id) join (select nd2_id, delta, target_s from ranked where place = 1 and delta_s between 0.75 * target_s and 1.25 * target_s) f on vids.nd2_id = f.nd2_id and b.delta = f.delta where hour_post_delivery is not null),
vnear as (select b.*, c.center, row_number() over (partition by unit_id, target_s, lag order by abs(x - c.center), c.center) as k from vnamed b cross join (select unnest([{", ".join(map(str, SCALED[:11]))}]::double[]) as center) c),
vunits as (select * from (select * exclude (k), row_number() over (partition by unit_id, target_s, center order by round(abs(x - center), 12), pair_count desc, lag) as place from vnear where k = 1) where place = 1)
"""
MATRIX_BINS = f"""{TARGET_V.split("raw as (")[0].replace("[10.0, 20.0, 40.0]", "[10.0]").rstrip().rstrip(",")}, raw as ({VCC.split(", raw as (", 1)[1]}, mbin as (select *, cast({_bin_case().replace("lag_median_s", "lag_s_median")} as double) as bin_s from matrices where normalized_value is not null),
mplaced as (select *, row_number() over (partition by unit_id, row_component, column_component, bin_s, direction order by round(case when bin_s > 0 then abs(ln(lag_s_median / bin_s)) else 0 end, 12), pair_count desc nulls last, lag) as place from mbin where bin_s is not null),
munit as (select unit_id, r, c, bin_s, avg(lag_s_median) as lag_s, avg(normalized_value) as nv, avg(raw_value) as rv, min(pair_count) as pair_count
  from (select *, case when direction = 'site2_later_vs_site1' then column_component else row_component end as r, case when direction = 'site2_later_vs_site1' then row_component else column_component end as c from mplaced where place = 1)
  group by unit_id, r, c, bin_s having count(distinct direction) = 2),
mids as (select unit_id, min(nd2_id) as nd2_id, min(crop_id) as crop_id, min(hour) as hour from frames group by unit_id)
select hour, r as row_component, c as column_component, bin_s, {_r("avg(lag_s)", "lag_s_mean", 5)}, {_r("avg(nv)", "normalized_mean", 5)}, {_r("stddev_samp(nv)", "normalized_sd", 5)}, {_r("avg(rv)", "raw_mean", 5)}, {_r("stddev_samp(rv)", "raw_sd", 5)},
  count(distinct unit_id) as n_units, count(distinct crop_id) as n_crops, count(distinct nd2_id) as n_acquisitions, cast(sum(pair_count) as bigint) as total_pairs from munit join mids using (unit_id) group by hour, r, c, bin_s"""

QUERIES = {f.__name__: f for f in (
    n_unit_bins, a_hour_curves, a_vcc_hour_curves, a_matrix_bins, n_scaled_bins, a_delta_curves, a_collapsed_curves, n_fine_grid, f_power_fits, f_trajectory_fits, t_alpha_extremes, t_alpha_cases, t_site_ranks, t_near_lag,
    f_vac_consistency, t_best_worst_hour, f_hour_trend, f_zero_crossing, f_fbm_fits, f_fbm_bootstrap, f_bootstrap_means, f_bootstrap_exponents, f_vcc_endpoints, f_vcc_endpoint_intervals, f_window_means, f_tau_grid, f_tau_bootstrap,
)}
ORACLES = {n: named_sql(sql) for n, sql in {
    "n_unit_bins": f"{BINS} select metric, unit_id, bundle_id, nd2_id, crop_id, {_six('hour_post_delivery')}, site, {_six('bin_s', 'lag_median_s', 'scaled_lag_tau_over_delta', 'delta_median_s', 'value', 'endpoint_pair_sd')}, pair_count, lag_frames from bins",
    "a_hour_curves": f"{HOURS} select metric, site, {_six('hour_post_delivery', 'bin_s', 'lag_s_mean', 'mean', 'sd', 'median', 'q25', 'q75')}, n_units, n_crops, n_acquisitions, total_pairs, available_units, {_six('retained_unit_fraction')} from hours",
    "n_scaled_bins": f"{SCALED_BINS} select {_six('hour_post_delivery')}, site, unit_id, {_six('delta_median_s', 'center')}, lag_frames, {_six('value')}, pair_count from scaled",
    "a_delta_curves": f"""{SCALED_BINS}, d as (select hour_post_delivery, site, center, avg(scaled_lag_tau_over_delta) as x_mean, avg(value) as mean, stddev_samp(value) as sd, median(value) as median, count(distinct unit_id) as n_units,
  count(distinct crop_id) as n_crops, cast(sum(pair_count) as bigint) as total_pairs, avg(delta_median_s) as delta_s_mean, min(delta_median_s) as delta_s_min, max(delta_median_s) as delta_s_max from scaled group by hour_post_delivery, site, center)
select {_six('hour_post_delivery')}, site, {_six('center', 'x_mean', 'mean', 'sd', 'median')}, n_units, n_crops, total_pairs, {_six('delta_s_mean', 'delta_s_min', 'delta_s_max')} from d""",
    "a_collapsed_curves": f"{SCALED_BINS} select {_six('hour_post_delivery')}, site, {_six('center', 'mean', 'sd')}, n_units, total_pairs from collapsed",
    "n_fine_grid": f"""{CLEAN}, g as (select *, round_even(scaled_lag_tau_over_delta / 0.25, 0) * 0.25 as grid from clean where metric = 'vac' and scaled_lag_tau_over_delta is not null),
o as (select *, row_number() over (partition by hour_post_delivery, site, unit_id, grid order by round(abs(scaled_lag_tau_over_delta - grid), 12), pair_count desc nulls last, lag_frames, value) as place from g),
f as (select hour_post_delivery, site, grid, avg(value) as mean, count(distinct unit_id) as n_units from o where place = 1 group by hour_post_delivery, site, grid)
select {_six('hour_post_delivery')}, site, {_six('grid', 'mean')}, n_units from f where n_units >= 3""",
    "f_power_fits": f"{POWER} select * from power",
    "f_trajectory_fits": f"{FITS} select * from fits",
    "t_alpha_extremes": f"""{FITS}, e as (select *, row_number() over (order by alpha, unit_id) as lo, row_number() over (order by alpha desc, unit_id) as hi from fits)
select unit_id, bundle_id, site, alpha, r2_log, fit_endpoint_pairs, 'lowest' as class, cast(lo as int) as rank from e where lo <= 10
union all select unit_id, bundle_id, site, alpha, r2_log, fit_endpoint_pairs, 'highest', cast(hi as int) from e where hi <= 10""",
    "t_site_ranks": f"""{FITS}, e as (select site, unit_id, alpha, cast(row_number() over (partition by site order by alpha, unit_id) as int) as low_rank, cast(row_number() over (partition by site order by alpha desc, unit_id) as int) as high_rank from fits)
select * from e where low_rank <= 10 or high_rank <= 10""",
    "t_near_lag": f"""{CLEAN}, o as (select *, row_number() over (partition by unit_id order by round(abs(lag_median_s - 10), 12), pair_count desc nulls last, lag_frames) as place from clean where metric = 'mscd' and lag_median_s between 7.5 and 12.5)
select unit_id, bundle_id, {_six('lag_median_s')}, {_six('value')}, pair_count from (select * from o where place = 1 order by o.value desc, unit_id limit 4)""",
    "f_vac_consistency": f"{RMSE} select * from rmse",
    "t_best_worst_hour": f"""{RMSE}, h as (select hour_post_delivery, avg(rmse) as rmse from rmse group by hour_post_delivery having count(distinct site) = 2)
select arg_min(hour_post_delivery, rmse) as best_hour, arg_max(hour_post_delivery, rmse) as worst_hour from h""",
    "f_hour_trend": f"""{POWER}, ra as (select metric, site, rank() over (partition by metric, site order by hour_post_delivery) + (count(*) over (partition by metric, site, hour_post_delivery) - 1) / 2.0 as a,
  rank() over (partition by metric, site order by exponent) + (count(*) over (partition by metric, site, exponent) - 1) / 2.0 as b from power where exponent is not null)
select metric, site, count(*) as n, {_r("case when stddev_samp(a) * stddev_samp(b) > 0 then covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) end", "rho")} from ra group by metric, site having count(*) >= 3""",
    "a_vcc_hour_curves": f"""{VCC_UNITS} select hour_post_delivery, target_s, center, {_r("avg(value)", "mean", 5)}, {_r("stddev_samp(value)", "sd", 5)}, {_r("median(value)", "median", 5)}, count(distinct unit_id) as n_units, count(distinct crop_id) as n_crops, {_r("avg(delta_s)", "delta_s", 5)}
from vunits group by hour_post_delivery, target_s, center""",
    "a_matrix_bins": MATRIX_BINS,
    "f_vcc_endpoints": f"""{UNIT_CURVES}, clean as (
  select metric, c.unit_id, c.unit_id as bundle_id, ids.nd2_id, crop_id, hour as hour_post_delivery, site, direction, m.delta is not null as is_primary_matched_10s, delta_s_median as delta_median_s, lag as lag_frames, lag_s_median as lag_median_s,
    lag_s_median / delta_s_median as scaled_lag_tau_over_delta, value, raw_value, sd as endpoint_pair_sd, pair_count, normalization
  from curves c join ids using (unit_id) left join matched m on ids.nd2_id = m.nd2_id and c.delta = m.delta where metric = 'vcc'){BINS[len(CLEAN):]}, o as (select hour_post_delivery, crop_id, unit_id, scaled_lag_tau_over_delta as x, value as y, lead(scaled_lag_tau_over_delta) over w as nx, lead(value) over w as ny from bins
  where metric = 'vcc' and scaled_lag_tau_over_delta between 0 and 5 and hour_post_delivery is not null window w as (partition by hour_post_delivery, crop_id, unit_id order by scaled_lag_tau_over_delta)),
u as (select hour_post_delivery, crop_id, unit_id, count(*) >= 3 and max(x) - min(x) >= 3 as wide, max(y) filter (abs(x) < 1e-6) as zero, sum((greatest(y, 0) + greatest(ny, 0)) / 2 * (nx - x)) filter (ny is not null) as area,
  min(case when ny is null then null when y = 0 then x when y * ny < 0 then x - y * (nx - x) / (ny - y) end) as crossing, avg(y) filter (x >= 3) as late from o group by all),
e as (select hour_post_delivery, crop_id, unit_id, 'zero_lag_trace' as endpoint, zero as v from u union all select hour_post_delivery, crop_id, unit_id, 'positive_auc', area from u where wide
  union all select hour_post_delivery, crop_id, unit_id, 'first_zero_crossing', crossing from u where wide union all select hour_post_delivery, crop_id, unit_id, 'late_mean', late from u)
select hour_post_delivery, endpoint, {_r("avg(v)", "estimate")}, count(distinct unit_id) as n_units, count(distinct crop_id) as n_crops from e where v is not null group by hour_post_delivery, endpoint""",
    "f_zero_crossing": f"""{SCALED_BINS}, z as (select *, lag(center) over w as px, lag(mean) over w as py from collapsed where hour_post_delivery is not null window w as (partition by site, hour_post_delivery order by center))
select site, hour_post_delivery, {_r("min(case when py = 0 then px when py * mean < 0 then px - py * (center - px) / (mean - py) end)", "zero_crossing", 5)} from z group by site, hour_post_delivery""",
}.items()}
