"""Queries over frames and bundles, with DuckDB SQL that restates each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.numeric import rounded
from trackloom.operators import cohorts, curves, points, resampling
from trackloom.plans.kernels import _r, _round, frames as bundle_frames
from trackloom.session import written
from trackloom.sources.tables import named_sql, named_table as table


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.clean_frames(table(spark, d, "frame_table"))


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.clean_bundles(table(spark, d, "bundle_metadata"))


def _movies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "acquisition_index").groupBy(F.col("nd2_id").alias("acquisition_id")).agg(F.max("movie_frames").alias("movie_frames"))


def q_bundle_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.bundle_summary(written(_frames(spark, d)), _bundles(spark, d)))


def q_point_channel(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.point_channel(_frames(spark, d)))


def q_missingness_census(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.missingness_census(_frames(spark, d), _bundles(spark, d)))


def q_missingness_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.missingness_asymmetry(_frames(spark, d)))


def q_technical_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.technical_hierarchy(_bundles(spark, d)))


def q_timing_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.timing_hierarchy(_frames(spark, d)))


def q_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.one_to_one(_bundles(spark, d))


def q_sensitivity_grid(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.sensitivity_grid(_bundles(spark, d)))


def q_primary_cohort(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.primary_cohort(_bundles(spark, d)).select("bundle_id", "included", "reasons")


def q_cohort_flow(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.cohort_flow(cohorts.primary_cohort(_bundles(spark, d)))


def q_tiers(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.tiers(written(_bundles(spark, d)), written(_frames(spark, d)))


def q_channels(spark: SparkSession, d: str) -> DataFrame:
    long = cohorts.channels_long(_frames(spark, d))
    return long.groupBy("channel").agg(F.count(F.lit(1)).alias("frames"), F.count_if("valid").alias("valid_frames"), F.count_if(F.col("valid").isNull()).alias("unknown_frames"))


def q_coverage_associations(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.coverage_associations(_bundles(spark, d)), 4)


def q_motion_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.motion_coverage(cohorts.step_speeds(_frames(spark, d)), _bundles(spark, d)))


def q_track_loss(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.track_loss(cohorts.step_speeds(_frames(spark, d))))


def q_motion_summary(spark: SparkSession, d: str) -> DataFrame:
    speeds = written(cohorts.step_speeds(_frames(spark, d)))
    return _round(cohorts.motion_summary(cohorts.motion_coverage(speeds, _bundles(spark, d)), cohorts.track_loss(speeds)))


def q_bundle_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.bundle_asymmetry(_bundles(spark, d)))


def q_dropout_stress(spark: SparkSession, d: str) -> DataFrame:
    return resampling.empirical_dropout(points.site_points(bundle_frames(spark, d)), 0.25, 7)


def q_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.frame_intervals(_frames(spark, d)))


def s_separation(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.separation_summary(cohorts.shared_separation(_frames(spark, d)).where("hour_post_delivery is not null"), keys=["hour_post_delivery"]), 3)


def s_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Every shared frame, however far apart: occurring bins and runs of empty ones."""
    runs = cohorts.separation_runs(cohorts.shared_separation(_frames(spark, d)), keys=["hour_post_delivery"])
    return runs.withColumn("probability", rounded("probability"))


def s_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.threshold_sweep(cohorts.shared_separation(_frames(spark, d))))


def s_shape_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.shape_candidates(s_threshold_sweep(spark, d), 3.5, (8.0, 12.0)))


def _hour_means(shared: DataFrame) -> DataFrame:
    per = shared.groupBy("bundle_id", "acquisition_id", "cell_id", "hour_post_delivery").agg((F.avg("separation_nm") / 1000).alias("mean_um"))
    return _round(curves.clustered_hour_means(per.withColumn("crop", F.concat_ws("|", "acquisition_id", "cell_id")), "hour_post_delivery", "crop", "mean_um"))


def s_hour_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _hour_means(cohorts.shared_separation(_frames(spark, d)))


def s_hour_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Difference of each hour's mean from the earliest hour's, two-sided normal p with Benjamini-Hochberg."""
    own = s_hour_statistics(spark, d)
    first = own.agg(F.min_by(F.struct("mean", "se"), "hour_post_delivery").alias("f"))
    z = (F.col("mean") - F.col("f.mean")) / F.sqrt(F.col("se") * F.col("se") + F.col("f.se") * F.col("f.se"))
    scored = own.join(F.broadcast(first), F.lit(True)).where("mean <> f.mean").select("hour_post_delivery", z.alias("z"))

    @F.pandas_udf("double")
    def p(z):
        return z.map(cohorts.normal_p)

    return curves.benjamini_hochberg(scored.withColumn("p", p("z")), "p", "hour_post_delivery")


def sel_complete_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.with_ranks(cohorts.complete_pairs(_frames(spark, d), _movies(spark, d)), "mean_nm"), 4)


def sel_extremes(spark: SparkSession, d: str) -> DataFrame:
    full = _round(cohorts.complete_pairs(_frames(spark, d), _movies(spark, d), (5, 10)), 4)
    return curves.extremes(full, 5, "mean_nm", "bundle_id").select("bundle_id", "mean_nm", "class", "rank")


def sel_hour_census(spark: SparkSession, d: str) -> DataFrame:
    every = _bundles(spark, d).where("hour_post_delivery is not null").groupBy("hour_post_delivery").agg(F.count(F.lit(1)).alias("bundles"))
    full = cohorts.complete_pairs(_frames(spark, d), _movies(spark, d)).groupBy("hour_post_delivery").agg(F.count(F.lit(1)).alias("complete"), F.sum("movie_frames").alias("complete_frames"))
    out = every.join(full, "hour_post_delivery", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("complete", "complete_frames")})
    return _round(out.withColumn("percent", F.lit(100.0) * F.col("complete") / F.col("bundles")))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.primary_cohort(_bundles(spark, d), cohorts.RELAXED).where("included and hour_post_delivery is not null")


def g_gallery(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.pair_gallery(_frames(spark, d).where("hour_post_delivery is not null"), _members(spark, d)))


def g_aligned(spark: SparkSession, d: str) -> DataFrame:
    return _round(cohorts.aligned_frames(_frames(spark, d), _members(spark, d)), 5)


def g_half_width(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.half_width(cohorts.aligned_frames(_frames(spark, d).where("hour_post_delivery is not null"), _members(spark, d)))


def v_frame_issues(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.frame_issues(table(spark, d, "frame_table"))


def v_bundle_issues(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.bundle_issues(table(spark, d, "bundle_metadata"))


def v_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.reconciliation(_frames(spark, d), _bundles(spark, d))


def _nn(c: str) -> str:
    return f"case when not isnan({c}) then {c} end as {c}"


QC = f"""
with bundles as (select * exclude (k) from (select * replace ({", ".join(_nn(c) for c in ("hour_post_delivery", "site1_coverage", "site2_coverage", "paired_coverage"))}),
  row_number() over (partition by bundle_id order by loaded_at) as k from bundle_metadata where bundle_id is not null) where k = 1),
qf as (select * exclude (k) from (select * replace ({", ".join(_nn(c) for c in ("hour_post_delivery", "micro_time_s", "frame_interval_s", "site1_x_nm", "site1_y_nm", "site2_x_nm", "site2_y_nm"))}),
  row_number() over (partition by bundle_id, frame order by loaded_at) as k from frame_table where bundle_id is not null and frame is not null and site1_valid is not null) where k = 1),
shared as (select *, sqrt((site2_x_nm - site1_x_nm) * (site2_x_nm - site1_x_nm) + (site2_y_nm - site1_y_nm) * (site2_y_nm - site1_y_nm)) as separation_nm from qf
  where site1_valid and site2_valid and isfinite(site1_x_nm) and isfinite(site1_y_nm) and isfinite(site2_x_nm) and isfinite(site2_y_nm)),
movies as (select nd2_id as acquisition_id, max(movie_frames) as movie_frames from acquisition_index group by all),
complete as (select acquisition_id, bundle_id, min(hour_post_delivery) as hour_post_delivery, count(*) as shared_frames, avg(separation_nm) as mean_nm, stddev_samp(separation_nm) as sd_nm, median(separation_nm) as median_nm, min(separation_nm) as min_nm, max(separation_nm) as max_nm,
  any_value(movie_frames) as movie_frames from shared join movies using (acquisition_id) group by acquisition_id, bundle_id having count(*) = any_value(movie_frames) and any_value(movie_frames) > 0)
"""


def _run(flag: str) -> str:
    return f"(select bundle_id, max(n) as longest from (select bundle_id, count(*) as n from (select bundle_id, frame - row_number() over (partition by bundle_id order by frame) as g from qf where {flag}) group by bundle_id, g) group by bundle_id)"


def _rules(thresholds: dict[str, float]) -> str:
    return "concat_ws('|', " + ", ".join(f"case when coalesce({c} < {t}, true) then '{c}' end" for c, t in thresholds.items()) + ")"


_SETS = "grouping sets ((), (hour_post_delivery), (acquisition_id), (acquisition_id, fov_id), (acquisition_id, fov_id, cell_id))"
_LEVEL = """case when grouping(hour_post_delivery) = 0 then 'hour' when grouping(cell_id) = 0 then 'cell' when grouping(fov_id) = 0 then 'fov' when grouping(acquisition_id) = 0 then 'acquisition' else 'overall' end as level"""
_KEYS = ("level", "hour_post_delivery", "acquisition_id", "fov_id", "cell_id")
COHORT = f"{QC}, cohort as (select *, {_rules(cohorts.PRIMARY)} as reasons from bundles)"
_OK1, _OK2 = ("coalesce(site{0}_valid and isfinite(site{0}_x_nm) and isfinite(site{0}_y_nm), false)".format(i) for i in (1, 2))
SPEEDS = f"""{QC}, channels as (
  select *, 'site1' as channel, {_OK1} as here, coalesce(site1_valid, false) as v, site1_x_nm as x, site1_y_nm as y from qf
  union all select *, 'site2', {_OK2}, coalesce(site2_valid, false), site2_x_nm, site2_y_nm from qf
  union all select *, 'paired', {_OK1} and {_OK2}, coalesce(site1_valid and site2_valid, false), (site1_x_nm + site2_x_nm) / 2, (site1_y_nm + site2_y_nm) / 2 from qf),
steps as (select *, micro_time_s - lag(micro_time_s) over w as dt, frame - lag(frame) over w as df, coalesce(lead(frame) over w - frame = 1, false) as has_next, lag(here) over w as before,
  x - lag(x) over w as dx, y - lag(y) over w as dy, coalesce(lead(v) over w, false) as nv from channels window w as (partition by channel, bundle_id order by frame)),
speeds as (select *, case when df = 1 and dt > 0 and isfinite(dt) and before and here then sqrt(dx * dx + dy * dy) / dt end as speed,
  case when channel = 'paired' and here then sqrt(pow(site2_x_nm - site1_x_nm, 2) + pow(site2_y_nm - site1_y_nm, 2)) end as separation from steps),
mper as (select channel, bundle_id, count(speed) as steps, median(speed) as speed from speeds group by all),
mcell as (select channel, b.acquisition_id, b.cell_id, round(avg(case channel when 'site1' then site1_coverage when 'site2' then site2_coverage else paired_coverage end), 9) as coverage, round(median(speed), 9) as speed
  from mper join bundles b using (bundle_id) where steps >= 5 and speed is not null and case channel when 'site1' then site1_coverage when 'site2' then site2_coverage else paired_coverage end is not null group by all),
mrank as (select channel, acquisition_id, rank() over (partition by channel, acquisition_id order by coverage) + (count(*) over (partition by channel, acquisition_id, coverage) - 1) / 2.0 as a,
  rank() over (partition by channel, acquisition_id order by speed) + (count(*) over (partition by channel, acquisition_id, speed) - 1) / 2.0 as b from mcell),
motion as (select channel, acquisition_id, count(*) as n, case when stddev_samp(a) * stddev_samp(b) > 0 then covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) end as rho from mrank group by all having count(*) >= 5),
le as (select channel, acquisition_id, cell_id, case when channel = 'paired' then separation else speed end as value, case when nv then 0.0 else 1.0 end as lost from speeds where has_next),
lq as (select channel, acquisition_id, quantile_cont(value, 0.75) as lim from le where value is not null group by all),
lc as (select channel, acquisition_id, cell_id, avg(lost) filter (value >= lim) as high, avg(lost) filter (value < lim) as low from le join lq using (channel, acquisition_id) where value is not null group by all),
loss as (select case when channel = 'paired' then 'loss_after_large_separation' else 'loss_after_high_speed' end as analysis, channel, acquisition_id, count(*) as cells, avg(high) as h, avg(low) as l, avg(high - low) as d, median(high - low) as m
  from lc where high is not null and low is not null group by all)
"""


def _codes(source: str, codes: dict[str, str], key: str) -> str:
    return " union all ".join(f"select '{c}' as code, count(*) as violations, min({key}) as example from {source} where {w} having count(*) > 0" for c, w in codes.items())


HOUR_STATS = f"""{QC}, per as (select bundle_id, acquisition_id, cell_id, hour_post_delivery, avg(separation_nm) / 1000 as v from shared group by all),
cl as (select hour_post_delivery, concat_ws('|', acquisition_id, cell_id) as crop, sum(v) as s, count(*) as m from per where hour_post_delivery is not null group by all),
hr as (select hour_post_delivery, cast(sum(m) as bigint) as n, count(*) as clusters, sum(s) / sum(m) as mean from cl group by hour_post_delivery),
meat as (select hour_post_delivery, sum(pow(s - m * mean, 2)) as meat from cl join hr using (hour_post_delivery) group by hour_post_delivery),
stats as (select hour_post_delivery, n, clusters, mean, sqrt(meat / (n * n) * (sum(clusters) over () / (sum(clusters) over () - 1.0)) * ((sum(n) over () - 1.0) / (sum(n) over () - count(*) over ()))) as se from hr join meat using (hour_post_delivery))
"""

QUERIES = {f.__name__: f for f in (
    q_bundle_summary, q_point_channel, q_missingness_census, q_missingness_asymmetry, q_technical_hierarchy, q_timing_hierarchy, q_one_to_one, q_sensitivity_grid, q_primary_cohort, q_cohort_flow, q_tiers,
    q_channels, q_coverage_associations, q_motion_coverage, q_track_loss, q_motion_summary, q_bundle_asymmetry, q_dropout_stress, q_intervals, s_separation, s_histogram, s_threshold_sweep, s_shape_candidates, s_hour_statistics, s_hour_p_values,
    sel_complete_pairs, sel_extremes, sel_hour_census, g_gallery, g_aligned, g_half_width, v_frame_issues, v_bundle_issues, v_reconciliation,
)}
ORACLES = {n: named_sql(sql) for n, sql in {
    "q_bundle_summary": f"""{QC}, c as (select bundle_id, count(*) as frame_rows, count(*) filter (site1_valid) as site1_count, count(*) filter (site2_valid) as site2_count, count(*) filter (paired_valid) as paired_count, count(*) filter (bp1_valid) as bp1_count from qf group by bundle_id)
select c.*, coalesce(r1.longest, 0) as longest_site1, coalesce(r2.longest, 0) as longest_site2, coalesce(rp.longest, 0) as longest_paired, nominal_frame_count as nominal,
  {_r("case when nominal_frame_count > 0 then site1_count / nominal_frame_count end", "site1_coverage")}, {_r("case when nominal_frame_count > 0 then site2_count / nominal_frame_count end", "site2_coverage")}, {_r("case when nominal_frame_count > 0 then paired_count / nominal_frame_count end", "paired_coverage")}
from c left join {_run("site1_valid")} r1 using (bundle_id) left join {_run("site2_valid")} r2 using (bundle_id) left join {_run("paired_valid")} rp using (bundle_id) left join (select bundle_id, nominal_frame_count from bundles) b using (bundle_id)""",
    "q_point_channel": f"""{QC}, c as (select bundle_id, count(*) as evaluable_frames, count(*) filter (bp1_valid) as detected_frames from qf where bp1_valid is not null group by bundle_id)
select c.*, coalesce(longest, 0) as longest_detected_run, {_r("detected_frames / evaluable_frames", "detection_fraction")}, case when detected_frames = 0 then 'not_detected' when detected_frames = evaluable_frames then 'always_detected' else 'detected' end as status
from c left join {_run("bp1_valid")} r using (bundle_id)""",
    "q_missingness_census": f"""{QC}, f as (select {_LEVEL}, hour_post_delivery, acquisition_id, fov_id, cell_id, count(*) as frame_rows, count(*) filter (site1_valid) as site1_frames, count(*) filter (site2_valid) as site2_frames, count(*) filter (paired_valid) as paired_frames, count(*) filter (bp1_valid) as bp1_frames from qf group by {_SETS}),
b as (select {_LEVEL}, hour_post_delivery, acquisition_id, fov_id, cell_id, count(distinct bundle_id) as bundle_count, median(paired_coverage) as median_paired_coverage, median(longest_paired_run) as median_longest_paired_run from bundles group by {_SETS})
select f.*, bundle_count, {_r("median_paired_coverage", "median_paired_coverage")}, {_r("median_longest_paired_run", "median_longest_paired_run")}, {", ".join(_r(f"{s}_frames / frame_rows", f"{s}_coverage") for s in ("site1", "site2", "paired", "bp1"))}
from f left join b on {" and ".join(f"f.{k} is not distinct from b.{k}" for k in _KEYS)}""",
    "q_missingness_asymmetry": f"""{QC}, a as (select case when grouping(hour_post_delivery) = 0 then 'hour' when grouping(acquisition_id) = 0 then 'acquisition' else 'overall' end as level, hour_post_delivery, acquisition_id, count(*) as frame_rows,
  count(*) filter (site1_valid and not coalesce(site2_valid, false)) as site1_only, count(*) filter (site2_valid and not site1_valid) as site2_only, count(*) filter (not site1_valid and not coalesce(site2_valid, false)) as both_missing,
  avg(case when site1_valid then 1.0 else 0.0 end) - avg(case when site2_valid then 1.0 else 0.0 end) as diff from qf group by grouping sets ((), (hour_post_delivery), (acquisition_id)))
select level, hour_post_delivery, acquisition_id, frame_rows, site1_only, site2_only, both_missing, {_r("diff", "site1_minus_site2")}, site1_only + site2_only as discordant, {_r("case when site1_only + site2_only > 0 then site1_only / (site1_only + site2_only) end", "site1_share")} from a""",
    "q_technical_hierarchy": f"""{QC} select acquisition_id, fov_id, count(distinct bundle_id) as bundle_count, count(distinct cell_id) as cell_count,
  {", ".join(_r(f"quantile_cont({s}_coverage, {p})", f"{s}_coverage_{n}") for s in ("site1", "site2", "paired") for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))},
  {_r("avg(case when coalesce(site1_valid_count, 0) > 0 and coalesce(site2_valid_count, 0) > 0 then 1.0 else 0.0 end)", "both_sites_fraction")}, {_r("avg(case when coalesce(paired_valid_count, 0) > 0 then 1.0 else 0.0 end)", "any_paired_fraction")}
from bundles group by acquisition_id, fov_id""",
    "q_timing_hierarchy": f"""{QC}, c as (select acquisition_id, fov_id, cell_id, median(frame_interval_s) as m, min(frame_interval_s) as lo, max(frame_interval_s) as hi from qf where frame_interval_s > 0 and isfinite(frame_interval_s) group by all),
a as (select acquisition_id, fov_id, count(distinct cell_id) as cell_count, median(m) as m, min(lo) as lo, max(hi) as hi from c group by acquisition_id, fov_id)
select acquisition_id, fov_id, cell_count, {_r("m", "interval_median_s")}, {_r("lo", "interval_min_s")}, {_r("hi", "interval_max_s")}, {_r("hi / lo", "max_min_ratio")}, hi / lo > 1.5 as ratio_gt_1_5, hi / lo > 2 as ratio_gt_2 from a""",
    "q_one_to_one": f"""{QC}, p as (select distinct acquisition_id, fov_id from bundles), b as (select max(k) as most_b from (select count(*) as k from p group by acquisition_id)), a as (select max(k) as most_a from (select count(*) as k from p group by fov_id))
select most_a = 1 and most_b = 1 as one_to_one, most_a, most_b from a, b""",
    "q_sensitivity_grid": f"""{QC} select c as min_coverage, cast(p as int) as min_paired, cast(r as int) as min_run, count(*) filter (site1_valid_count >= 20 and site2_valid_count >= 20 and paired_coverage >= c and paired_valid_count >= p and longest_paired_run >= r) as included,
  count(*) as eligible, {_r("count(*) filter (site1_valid_count >= 20 and site2_valid_count >= 20 and paired_coverage >= c and paired_valid_count >= p and longest_paired_run >= r) / count(*)", "inclusion_fraction")}
from bundles, (select unnest([0.4, 0.6, 0.8]::double[]) as c), (select unnest([10, 20, 30]) as p), (select unnest([5, 10, 20]) as r) group by c, p, r""",
    "q_primary_cohort": f"{COHORT} select bundle_id, reasons = '' as included, reasons from cohort",
    "q_cohort_flow": f"""{COHORT}, r as (select *, unnest(string_split(reasons, '|')) as reason from cohort where reasons <> '')
select 'overall' as flow, case when reasons = '' then 'included' else 'excluded' end as reason, cast(null as double) as hour_post_delivery, cast(null as varchar) as acquisition_id, count(*) as bundles from cohort group by 2
union all select 'total', reason, null, null, count(*) from r group by reason
union all select 'by_hour_acquisition', reason, hour_post_delivery, acquisition_id, count(*) from r group by reason, hour_post_delivery, acquisition_id""",
    "q_tiers": f"""{QC}, t3 as (select bundle_id from bundles where {_rules(cohorts.RELAXED)} = ''), t4 as (select bundle_id from bundles where {_rules(cohorts.PRIMARY)} = ''),
v as (select 'T1' as tier, 'shared' as cohort, bundle_id, acquisition_id from qf where paired_valid union all select 'T2', 'site1', bundle_id, acquisition_id from qf where site1_valid union all select 'T2', 'site2', bundle_id, acquisition_id from qf where site2_valid
  union all select 'T3', 'relaxed', bundle_id, acquisition_id from qf where bundle_id in (select bundle_id from t3) union all select 'T4', 'strict', bundle_id, acquisition_id from qf where bundle_id in (select bundle_id from t4))
select tier, cohort, count(*) as frames, count(distinct bundle_id) as bundles, count(distinct acquisition_id) as acquisitions from v group by tier, cohort""",
    "q_channels": f"""{QC}, l as (select 'site1' as channel, site1_valid as v from qf union all select 'site2', site2_valid from qf union all select 'bp1', bp1_valid from qf)
select channel, count(*) as frames, count(*) filter (v) as valid_frames, count(*) filter (v is null) as unknown_frames from l group by channel""",
    "q_coverage_associations": f"""{QC}, c as (select acquisition_id, fov_id, cell_id, round(avg(site1_coverage), 12) as s1, round(avg(site2_coverage), 12) as s2, round(avg(paired_coverage), 12) as sp from bundles group by acquisition_id, fov_id, cell_id),
l as (select acquisition_id, 'site1_coverage' as outcome, s1 as v from c where s1 is not null union all select acquisition_id, 'site2_coverage', s2 from c where s2 is not null union all select acquisition_id, 'paired_coverage', sp from c where sp is not null),
r as (select *, rank() over (partition by outcome order by v) + (count(*) over (partition by outcome, v) - 1) / 2.0 as r from l),
ties as (select outcome, sum(k * k * k - k) as t from (select outcome, v, cast(count(*) as double) as k from l group by outcome, v) group by outcome),
per as (select outcome, acquisition_id, sum(r) as s, cast(count(*) as double) as m from r group by outcome, acquisition_id),
tot as (select outcome, sum(m) as n, count(*) as g, sum(s * s / m) as q from per group by outcome),
h as (select outcome, n, g, case when g >= 2 and n > g and t < n * n * n - n then (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) end as h from tot join ties using (outcome))
select outcome, cast(n as bigint) as n, g as groups, {_r("h", "kruskal_h", 4)}, {_r("case when h is not null then greatest(0.0, (h - g + 1) / (n - g)) end", "epsilon_squared", 4)} from h""",
    "q_motion_coverage": f"""{SPEEDS} select channel, acquisition_id, n, {_r("rho", "rho")} from motion""",
    "q_track_loss": f"""{SPEEDS} select analysis, channel, acquisition_id, cells, {", ".join(_r(f"case when cells >= 5 then {a} end", n) for a, n in (("h", "risk_high"), ("l", "risk_reference"), ("d", "mean_difference"), ("m", "median_difference")))}, cells >= 5 as supported from loss""",
    "q_motion_summary": f"""{SPEEDS}, u as (select 'coverage_against_motion' as analysis, channel, rho as e, rho is not null as ok from motion union all select analysis, channel, d, cells >= 5 and d is not null from loss)
select analysis, channel, count(*) as assessed, count(*) filter (ok) as supported, {_r("median(e) filter (ok)", "median_effect")}, {_r("min(e) filter (ok)", "least_effect")}, {_r("max(e) filter (ok)", "largest_effect")} from u group by analysis, channel""",
    "q_bundle_asymmetry": f"""{QC} select bundle_id, acquisition_id, {_r("hour_post_delivery", "hour_post_delivery")}, {_r("site1_coverage - site2_coverage", "coverage_difference")}, {_r("abs(site1_coverage - site2_coverage)", "absolute_difference")} from bundles""",
    "q_intervals": f"""{QC} select bundle_id, frame, {_r("coalesce(lead(micro_time_s) over w - micro_time_s, micro_time_s - lag(micro_time_s) over w, frame_interval_s)", "interval_s")} from qf window w as (partition by bundle_id order by frame)""",
    "s_separation": f"""{QC} select hour_post_delivery, count(*) as frames, count(distinct bundle_id) as bundles, count(*) filter (separation_nm > 550) as above, {_r("100.0 * count(*) filter (separation_nm > 550) / count(*)", "percent_above", 3)},
  {_r("median(separation_nm)", "median_nm", 3)}, {_r("quantile_cont(separation_nm, 0.25)", "q25_nm", 3)}, {_r("quantile_cont(separation_nm, 0.75)", "q75_nm", 3)}, {_r("max(separation_nm)", "max_nm", 3)} from shared where hour_post_delivery is not null group by hour_post_delivery""",
    "s_histogram": f"""{QC}, c as (select hour_post_delivery, cast(floor(separation_nm / 50) as bigint) as bin, count(*) as n from shared group by all), t as (select hour_post_delivery, sum(n) as total from c group by all),
marks as (select * from c union all select hour_post_delivery, (select max(bin) + 1 from c), null from t), gaps as (select hour_post_delivery, bin, 1 + lag(bin, 1, -1) over (partition by hour_post_delivery order by bin) as start from marks),
r as (select hour_post_delivery, bin as a, bin + 1 as b, n from c union all select hour_post_delivery, start, least(bin, 11), 0 from gaps where start < least(bin, 11) union all select hour_post_delivery, greatest(start, 11), bin, 0 from gaps where greatest(start, 11) < bin)
select r.hour_post_delivery, a * 50.0::double as bin_left_nm, b * 50.0::double as bin_right_nm, cast(n as bigint) as frames, {_r("n / total", "probability")}, case when a >= 11 then 'above' else 'at_or_below' end as side
from r join t on r.hour_post_delivery is not distinct from t.hour_post_delivery""",
    "s_threshold_sweep": f"""{QC} select hour_post_delivery, cast(t as double) as threshold_nm, count(*) as frames, count(*) filter (separation_nm > t) as above, {_r("100.0 * count(*) filter (separation_nm > t) / count(*)", "percent_above")}
from shared, (select unnest(range(400, 1001, 25)) as t) where hour_post_delivery is not null group by hour_post_delivery, t""",
    "s_shape_candidates": f"""{QC}, w as (select hour_post_delivery as h, cast(t as double) as threshold_nm, {_r("100.0 * count(*) filter (separation_nm > t) / count(*)", "p")} from shared, (select unnest(range(400, 1001, 50)) as t) where hour_post_delivery is not null group by hour_post_delivery, t),
u as (select *, case when h <= 3.5 then p > lag(p) over (partition by threshold_nm order by h) end as up from w),
a as (select threshold_nm, bool_and(coalesce(up, true)) as rises, max(p) filter (h = 3.5) as peak, max(p) filter (h = 8) as l0, max(p) filter (h = 12) as l1, arg_min(p, h) as first from u group by threshold_nm)
select threshold_nm, coalesce(rises and peak is not null and l0 < peak and l1 < peak, false) as shape_ok, {_r("peak - first", "rise")}, {_r("peak - l1", "drop")} from a""",
    "s_hour_statistics": f"{HOUR_STATS} select hour_post_delivery, n, clusters, {_r('mean', 'mean')}, {_r('se', 'se')} from stats",
    "sel_complete_pairs": f"""{QC} select acquisition_id, bundle_id, hour_post_delivery, shared_frames, movie_frames, {", ".join(_r(c, c, 4) for c in ("mean_nm", "sd_nm", "median_nm", "min_nm", "max_nm"))},
  cast(row_number() over (order by round(mean_nm, 9), bundle_id) as int) as shortest_rank, cast(row_number() over (order by round(mean_nm, 9) desc, bundle_id) as int) as longest_rank from complete""",
    "sel_extremes": f"""{QC}, m as (select bundle_id, {_r("mean_nm", "mean_nm", 4)} from complete where movie_frames not in (5, 10)), e as (select *, row_number() over (order by m.mean_nm, bundle_id) as lo, row_number() over (order by m.mean_nm desc, bundle_id) as hi from m)
select bundle_id, mean_nm, 'lowest' as class, cast(lo as int) as rank from e where lo <= 5 union all select bundle_id, mean_nm, 'highest', cast(hi as int) from e where hi <= 5""",
    "sel_hour_census": f"""{QC}, a as (select hour_post_delivery, count(*) as bundles from bundles where hour_post_delivery is not null group by all), c as (select hour_post_delivery, count(*) as complete, cast(sum(movie_frames) as bigint) as complete_frames from complete group by all)
select hour_post_delivery, bundles, coalesce(complete, 0) as complete, coalesce(complete_frames, 0) as complete_frames, {_r("100.0 * coalesce(complete, 0) / bundles", "percent")} from a left join c using (hour_post_delivery)""",
    "g_gallery": f"""{QC}, m as (select bundle_id from bundles where {_rules(cohorts.RELAXED)} = '' and hour_post_delivery is not null),
g as (select bundle_id, min(hour_post_delivery) as hour_post_delivery, count(*) as paired_frames, sqrt(var_pop(site1_x_nm / 1000) + var_pop(site1_y_nm / 1000)) as r1, sqrt(var_pop(site2_x_nm / 1000) + var_pop(site2_y_nm / 1000)) as r2
  from shared where hour_post_delivery is not null and bundle_id in (select bundle_id from m) group by bundle_id), q as (select *, sqrt((r1 * r1 + r2 * r2) / 2) as r from g)
select bundle_id, hour_post_delivery, paired_frames, {_r("r1", "site1_rg_um")}, {_r("r2", "site2_rg_um")}, {_r("r", "rg_rms_um")}, cast(row_number() over (partition by hour_post_delivery order by round(r, 9), bundle_id) as int) as gallery_rank from q""",
    "g_aligned": f"""{QC}, m as (select bundle_id from bundles where {_rules(cohorts.RELAXED)} = '' and hour_post_delivery is not null),
s as (select *, avg((site1_x_nm + site2_x_nm) / 2) over (partition by bundle_id) as mx, avg((site1_y_nm + site2_y_nm) / 2) over (partition by bundle_id) as my from shared where bundle_id in (select bundle_id from m))
select bundle_id, frame, {", ".join(_r(f"(site{s}_{a}_nm - m{a}) / 1000", f"site{s}_{a}_um", 5) for s in (1, 2) for a in "xy")} from s""",
    "g_half_width": f"""{QC}, m as (select bundle_id from bundles where {_rules(cohorts.RELAXED)} = '' and hour_post_delivery is not null),
s as (select *, avg((site1_x_nm + site2_x_nm) / 2) over (partition by bundle_id) as mx, avg((site1_y_nm + site2_y_nm) / 2) over (partition by bundle_id) as my from shared where hour_post_delivery is not null and bundle_id in (select bundle_id from m))
select ceil(greatest(max(abs(site1_x_nm - mx)), max(abs(site1_y_nm - my)), max(abs(site2_x_nm - mx)), max(abs(site2_y_nm - my))) / 1000 * 4) / 4 as half_width_um from s""",
    "v_frame_issues": """with q as (select *, lag(frame) over w as sf, lag(case when not isnan(micro_time_s) then micro_time_s end) over w as bt, case when not isnan(micro_time_s) then micro_time_s end as t, case when not isnan(frame_interval_s) then frame_interval_s end as gap, lag(case when not isnan(frame_interval_s) then frame_interval_s end) over w as bg, row_number() over w as place, case when not isnan(hour_post_delivery) then hour_post_delivery end as hour,
  min(coalesce(acquisition_id, '')) over v <> max(coalesce(acquisition_id, '')) over v as x_acquisition_id, min(coalesce(fov_id, '')) over v <> max(coalesce(fov_id, '')) over v as x_fov_id, min(coalesce(cell_id, '')) over v <> max(coalesce(cell_id, '')) over v as x_cell_id
  from frame_table window w as (partition by bundle_id order by frame, loaded_at), v as (partition by bundle_id)) """ + _codes(
        "q",
        {
            "missing_bundle_id": "bundle_id is null", "missing_frame": "frame is null", "missing_time": "t is null", "negative_time": "t < 0", "duplicate_key": "bundle_id is not null and sf = frame",
            "time_not_increasing": "bundle_id is not null and sf < frame and t <= bt",
            "valid_without_coordinates": "(site1_valid and (site1_x_nm is null or isnan(site1_x_nm) or site1_y_nm is null or isnan(site1_y_nm))) or (site2_valid and (site2_x_nm is null or isnan(site2_x_nm) or site2_y_nm is null or isnan(site2_y_nm)))",
            "pair_flag_disagrees": "site1_valid is not null and coalesce(paired_valid, false) <> (site1_valid and coalesce(site2_valid, false))", "missing_hour": "hour is null",
            "invalid_hour": "hour is not null and not (hour between 0 and 1e6)", "invalid_frame": "frame < 0", "invalid_frame_interval": "gap is null or not (gap > 0 and isfinite(gap))",
            "frame_interval_mismatch": "bundle_id is not null and sf < frame and abs(t - bt - bg * (frame - sf)) > 1e-6 + 0.05 * abs(bg * (frame - sf))",
            **{f"blank_{c}": f"{c} is null or trim({c}) = ''" for c in ("biological_experiment_id", "acquisition_id", "fov_id", "cell_id")},
            **{f"bundle_crosses_{c}": f"bundle_id is not null and place = 1 and x_{c}" for c in ("acquisition_id", "fov_id", "cell_id")},
        },
        "concat_ws('#', coalesce(bundle_id, ''), coalesce(cast(frame as varchar), ''))",
    ),
    "v_bundle_issues": "with q as (select *, case when not isnan(site1_coverage) then site1_coverage end as c1, case when not isnan(site2_coverage) then site2_coverage end as c2, case when not isnan(paired_coverage) then paired_coverage end as cp from bundle_metadata) " + _codes(
        "q",
        {
            "missing_bundle_id": "bundle_id is null", "blank_cell_id": "cell_id is null or trim(cell_id) = ''",
            "count_over_nominal": "site1_valid_count > nominal_frame_count or site2_valid_count > nominal_frame_count or paired_valid_count > nominal_frame_count",
            "paired_over_site": "paired_valid_count > least(site1_valid_count, site2_valid_count)", "coverage_outside_unit": "c1 < 0 or c1 > 1 or c2 < 0 or c2 > 1 or cp < 0 or cp > 1",
            "coverage_disagrees": "abs(c1 - site1_valid_count / nominal_frame_count) > 1e-9 or abs(c2 - site2_valid_count / nominal_frame_count) > 1e-9 or abs(cp - paired_valid_count / nominal_frame_count) > 1e-9",
            "missing_hour": "hour_post_delivery is null or isnan(hour_post_delivery)",
        },
        "coalesce(bundle_id, '')",
    ),
    "v_reconciliation": f"""{QC}, c as (select bundle_id, count(*) filter (site1_valid) as s1, count(*) filter (site2_valid) as s2, count(*) filter (paired_valid) as sp, min(acquisition_id) as aq, true as f from qf group by bundle_id),
b as (select *, true as b from bundles), j as (select coalesce(c.bundle_id, b.bundle_id) as id, c.* exclude (bundle_id), b.* exclude (bundle_id) from c full join b on c.bundle_id = b.bundle_id) """ + _codes(
        "j",
        {
            "bundle_without_metadata": "b is null", "bundle_without_frames": "f is null", "site1_count_disagrees": "f and b and s1 <> site1_valid_count", "site2_count_disagrees": "f and b and s2 <> site2_valid_count",
            "paired_count_disagrees": "f and b and sp <> paired_valid_count", "acquisition_disagrees": "f and b and aq <> acquisition_id",
        },
        "id",
    ),
}.items()}
