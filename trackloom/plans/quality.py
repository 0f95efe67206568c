"""Queries of the data-quality problems 1, 2, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import orphans, regular_grid, schema_drift, spikes
from trackloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "export_records"))


def p1_frame_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, d, "export_records"), "frame_table")


def p1_bundle_metadata(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, d, "export_records"), "bundle_metadata")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.by_bundle(*(table(spark, d, t) for t in ("frame_table", "bundle_metadata", "acquisition_index")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_grid(spark, d).where("state <> 'observed'").select("bundle_id", "slot", "series")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    frames, bundles, crops = (table(spark, d, t) for t in ("frame_table", "bundle_metadata", "crop_index"))
    key = lambda a, b: F.concat(F.col(a), F.lit("|"), F.col(b))
    refs = frames.select(F.lit("frame_table").alias("relation"), F.col("bundle_id").alias("ref_key"), "loaded_at").union(
        bundles.select(F.lit("bundle_metadata"), key("acquisition_id", "cell_id"), "loaded_at")
    )
    parents = bundles.select(F.lit("frame_table").alias("relation"), F.col("bundle_id").alias("ref_key"), "loaded_at", "deleted_at").union(
        crops.select(F.lit("bundle_metadata"), key("nd2_id", "crop_id"), "loaded_at", "deleted_at")
    )
    return orphans.orphan_references(refs, parents)


P4_SQL = """
with refs as (
  select 'frame_table' as table_name, bundle_id as ref_key, loaded_at from frame_table
  union all select 'bundle_metadata', acquisition_id || '|' || cell_id, loaded_at from bundle_metadata),
parents as (
  select 'frame_table' as table_name, bundle_id as ref_key, min(loaded_at) as born, min(deleted_at) as gone from bundle_metadata group by all
  union all select 'bundle_metadata', nd2_id || '|' || crop_id, min(loaded_at), min(deleted_at) from crop_index group by all)
select distinct table_name, ref_key, period, kind from (
  select r.table_name, r.ref_key, strftime(r.loaded_at, '%Y-%m') as period,
    case when p.ref_key is null then 'missing' when p.gone <= r.loaded_at then 'deleted' when p.born > r.loaded_at then 'late' end as kind
  from refs r left join parents p on r.table_name = p.table_name and r.ref_key = p.ref_key
  where r.ref_key is not null) where kind is not null
"""


def p5_readings(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "acquisition_index").groupBy(F.col("nd2_id").alias("acquisition_id")).agg(F.max("field_width_nm").alias("limit"))
    frames = table(spark, d, "frame_table").where("site1_valid is not null")
    return spikes.implausible_readings(frames, limits)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_readings(spark, d).where("kind not in ('level_shift', 'outlier')").select("bundle_id", "frame", "field")


P2_SQL = """
with clock as (
  select nd2_id, median_interval_s as h, cast(floor(movie_duration_s / median_interval_s + 0.5) as bigint) as last_slot from acquisition_index where median_interval_s > 0),
own as (
  select f.* from frame_table f where bundle_id in (select bundle_id from bundle_metadata where bundle_id is not null)),
bundles as (
  select bundle_id, acquisition_id from own where site1_valid is not null group by all),
grid as (
  select bundle_id, unnest(range(0, last_slot + 1)) as slot from bundles join clock on acquisition_id = nd2_id),
seen as (
  select bundle_id, cast(floor(micro_time_s / h + 0.5) as bigint) as slot, max(coalesce(site1_valid, false)) as s1, max(coalesce(paired_valid, false)) as sp
  from own join clock on acquisition_id = nd2_id where micro_time_s is not null and not isnan(micro_time_s) and abs(micro_time_s) < 1e12 group by all),
cells as (select g.bundle_id, g.slot, coalesce(s1, false) as s1, coalesce(sp, false) as sp from grid g left join seen s on g.bundle_id = s.bundle_id and g.slot = s.slot)
select bundle_id, slot, 'site1' as series from cells where not s1
union all select bundle_id, slot, 'paired' from cells where not sp
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_frame_table": p1_frame_table,
    "p1_bundle_metadata": p1_bundle_metadata,
    "p2_found": p2_found,
    "p2_grid": p2_grid,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_readings": p5_readings,
}
ORACLES = {"p2_found": P2_SQL, "p4_found": P4_SQL}
