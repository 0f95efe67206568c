"""Queries of the problems 3 and 6 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import byte_bpe, packing, percentiles, same_look
from trackloom.session import written

PERCENTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the three measures: of every part (scope `part`: a day of loading, an acquisition, a metric),
    and of the groups (scope `whole`), whose summaries are the sums of their parts' summaries."""
    none = F.lit(None).cast("string")
    frames = spark.read.parquet(f"{d}/frame_table.parquet").select("acquisition_id", F.date_format("loaded_at", "yyyy-MM-dd").alias("day"), "frame_interval_s")
    curves = spark.read.parquet(f"{d}/unit_curves.parquet")
    hour = F.when(~F.isnan("hour_post_delivery"), F.col("hour_post_delivery").cast("string"))
    curves = curves.select("metric", hour.alias("hour"), "nd2_id", "value")
    by_curve = written(percentiles.summarise(curves, "value", ["metric", "hour", "nd2_id"]))
    name = lambda measure, a, b, part: [F.lit(measure).alias("measure"), a.alias("group_a"), b.alias("group_b"), part.alias("part"), "x", "n"]
    keys = ["measure", "group_a", "group_b"]
    parts = written(
        percentiles.combine(
            percentiles.summarise(frames, "frame_interval_s", ["acquisition_id", "day"]).select(*name("frame_interval_s by acquisition_id", F.col("acquisition_id"), none, F.col("day"))),
            by_curve.select(*name("value by metric and hour", F.col("metric"), F.col("hour"), F.col("nd2_id"))),
            by_curve.select(*name("value by nd2_id", F.col("nd2_id"), none, F.col("metric"))),
            groups=[*keys, "part"],
        )
    )
    whole = percentiles.combine(parts, groups=keys).withColumns({"part": none, "scope": F.lit("whole")})
    every = parts.withColumn("scope", F.lit("part")).unionByName(whole)
    found = percentiles.percentiles(every, ["scope", *keys, "part"], PERCENTILES)
    return found.withColumn("percentile", F.round("percentile", 9))


P3_SQL = f"""
with v as (
  select 'frame_interval_s by acquisition_id' as measure, acquisition_id as group_a, cast(null as varchar) as group_b, strftime(loaded_at, '%Y-%m-%d') as part, frame_interval_s as value from frame_table
  union all select 'value by metric and hour', metric, cast(case when not isnan(hour_post_delivery) then hour_post_delivery end as varchar), nd2_id, value from unit_curves
  union all select 'value by nd2_id', nd2_id, cast(null as varchar), metric, value from unit_curves),
k as (
  select 'part' as scope, * from v where value is not null and not isnan(value)
  union all select 'whole', measure, group_a, group_b, null, value from v where value is not null and not isnan(value)),
ps as (select unnest([{", ".join(map(str, PERCENTILES))}]::double[]) as p),
o as (select *, row_number() over (partition by scope, measure, group_a, group_b, part order by value) - 1 as r from k),
c as (select scope, measure, group_a, group_b, part, count(*) as n from k group by all),
t as (select c.*, p, floor(p * (n - 1)) as lo, ceil(p * (n - 1)) as hi from c, ps)
select t.scope, t.measure, t.group_a, t.group_b, t.part, p, n, 0.0::double as error,
  round(max(case when r = lo then value end) * (1 - (p * (n - 1) - lo)) + max(case when r = hi then value end) * (p * (n - 1) - lo), 9) as percentile
from t join o on t.scope = o.scope and t.measure = o.measure and t.group_a is not distinct from o.group_a
  and t.group_b is not distinct from o.group_b and t.part is not distinct from o.part and r in (lo, hi)
group by t.scope, t.measure, t.group_a, t.group_b, t.part, p, n, lo, hi
"""


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.encode(_docs(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    # a fixed table of four rows
    sizes = spark.read.parquet(f"{d}/pack_sizes.parquet").select("pack_id", "capacity_tokens").orderBy("pack_id")
    return packing.pack(byte_bpe.token_counts(_docs(spark, d)), [tuple(r) for r in sizes.collect()])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look.same_look_pairs(_docs(spark, d))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return same_look.consistent_form(_docs(spark, d)).select("doc_id", "form")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return same_look.same_look_classes(_docs(spark, d))


QUERIES = {"p3_percentiles": p3_percentiles, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found, "p8_forms": p8_forms, "p8_classes": p8_classes}
ORACLES: dict[str, str] = {"p3_percentiles": P3_SQL}
