"""Acquisition schedules, matched measurement offsets, unit curves of all metrics and the support census."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.contracts import present
from trackloom.operators import dense, lags, points
from trackloom.session import written

PAPER_DELTAS = (1, 2, 4, 8)


def schedule_report(frame_table: DataFrame, acquisition_index: DataFrame) -> DataFrame:
    """Per acquisition: frames seen and absent, frames with conflicting times, and steps that do not increase."""
    t = present("micro_time_s")
    per = (
        frame_table.where(t >= 0)
        .groupBy(F.col("acquisition_id").alias("nd2_id"), "frame")
        .agg(F.min(t).alias("low"), F.median(t).alias("time_s"), F.max(t).alias("high"))
    )
    along = Window.partitionBy("nd2_id").orderBy("frame")
    checked = per.withColumns(
        {
            "conflict": (F.col("high") - F.col("low")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("time_s")),
            "back": F.col("time_s") <= F.lag("time_s").over(along),
        }
    )
    found = checked.groupBy("nd2_id").agg(F.count(F.lit(1)).alias("frames_seen"), F.count_if("conflict").alias("conflicting"), F.count_if("back").alias("not_increasing"))
    movies = acquisition_index.groupBy("nd2_id").agg(F.max("movie_frames").alias("movie_frames"))
    return movies.join(found, "nd2_id", "left").select(
        "nd2_id", "movie_frames", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("frames_seen", "conflicting", "not_increasing")],
        (F.col("movie_frames") - F.coalesce("frames_seen", F.lit(0))).alias("absent"),
    )


def matched_delta(clock: DataFrame, targets: Sequence[float] = (10.0,), low: float = 0.75, high: float = 1.25) -> DataFrame:
    """(nd2_id, target_s, delta, delta_s): the frame offset whose median duration is nearest to the target, of
    equals the smaller; delta null where that duration is outside low..high times the target. The offsets of a
    schedule are bounded by its frames."""
    a = clock.select("nd2_id", F.col("frame").alias("f0"), F.col("time_s").alias("t0"))
    b = clock.select("nd2_id", F.col("frame").alias("f1"), F.col("time_s").alias("t1"))
    spans = a.join(b, "nd2_id").where("f1 > f0").groupBy("nd2_id", (F.col("f1") - F.col("f0")).cast("int").alias("delta")).agg(F.median(F.col("t1") - F.col("t0")).alias("delta_s"))
    wanted = spans.withColumn("target_s", F.explode(F.array(*[F.lit(float(x)) for x in targets])))
    best = wanted.groupBy("nd2_id", "target_s").agg(F.min(F.struct(F.abs(F.col("delta_s") - F.col("target_s")).alias("off"), "delta", "delta_s")).alias("m"))
    inside = F.col("m.delta_s").between(F.col("target_s") * low, F.col("target_s") * high)
    return best.select("nd2_id", "target_s", F.when(inside, F.col("m.delta")).alias("delta"), F.col("m.delta_s").alias("delta_s"))


def delta_family(matched: DataFrame, paper: Sequence[int] = PAPER_DELTAS) -> DataFrame:
    """(nd2_id, delta, role, is_primary): the paper's offsets and the matched one of each acquisition."""
    listed = matched.select("nd2_id", "delta", F.explode(F.array_distinct(F.concat(F.array(*[F.lit(int(d)) for d in paper]), F.when(F.col("delta").isNotNull(), F.array("delta")).otherwise(F.array().cast("array<int>"))))).alias("d"))
    return listed.select(
        "nd2_id", F.col("d").alias("delta"), F.when(F.col("d").isin(*paper), "paper_family").otherwise("primary_matched_10s").alias("role"),
        F.coalesce(F.col("d") == F.col("delta"), F.lit(False)).alias("is_primary"),
    )


def unit_curves(frames: DataFrame, clock: DataFrame, min_pairs: int = 8) -> DataFrame:
    """All finite curve points of every unit: metric, unit_id, site, direction, delta, is_primary, lag, lag_s_median,
    value, raw_value, sd, pair_count, normalization."""
    deltas = written(delta_family(matched_delta(clock)))
    return with_identity(dense.unit_curves(frames, deltas, min_pairs), frames, deltas)


def with_identity(curves: DataFrame, frames: DataFrame, deltas: DataFrame) -> DataFrame:
    """Curves with their unit's identity, and whether their offset is the primary one."""
    ids = frames.groupBy("unit_id").agg(*[F.min(c).alias(c) for c in lags.IDENTITY])
    primary = deltas.where("is_primary").select("nd2_id", "delta", F.lit(True).alias("is_primary"))
    return curves.join(ids, "unit_id").join(primary, ["nd2_id", "delta"], "left").withColumn("is_primary", F.coalesce("is_primary", F.lit(False)))


def unit_curves_by_joins(frames: DataFrame, clock: DataFrame, min_pairs: int = 8) -> DataFrame:
    """The same curves from the pair joins of `lags`, one kernel each."""
    one, two = points.site_points(frames), points.paired_points(frames)
    deltas = written(delta_family(matched_delta(clock)))
    v = written(lags.velocities(one, deltas))  # both correlations join it with itself
    columns = ["metric", "unit_id", "site", "direction", "delta", "lag", "lag_s_median", "delta_s_median", "value", "raw_value", "sd", "pair_count", "normalization"]

    def shape(df: DataFrame, metric: str) -> DataFrame:
        have = {c: F.col(c) for c in df.columns}
        kinds = {"site": "string", "direction": "string", "delta": "int"}
        raw = have.get("raw_value", F.col("value"))
        return df.where("value is not null").select(
            F.lit(metric).alias("metric"), *[raw.alias(c) if c == "raw_value" else have.get(c, F.lit(None).cast(kinds.get(c, "double"))).alias(c) for c in columns[1:]]
        )

    every = [
        shape(lags.mean_squared_displacement(one, min_pairs), "msd"),
        shape(lags.mean_squared_displacement(two, min_pairs), "mscd"),
        shape(lags.velocity_autocorrelation(v, min_pairs), "vac"),
        shape(lags.velocity_cross_correlation(v, min_pairs), "vcc"),
    ]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return with_identity(out, frames, deltas)


def support_census(frames: DataFrame, curves: DataFrame, min_pairs: int = 8) -> DataFrame:
    """Every attempted unit and displacement metric with its support, failures included, and the reason."""
    seen = frames.groupBy("unit_id", "nd2_id").agg(
        F.max("movie_frames").alias("movie_frames"), F.count("x1").alias("site1"), F.count("x2").alias("site2"),
        F.count_if(F.col("x1").isNotNull() & F.col("x2").isNotNull()).alias("pair"),
    )
    grid = seen.select("unit_id", "movie_frames", F.expr("stack(3,'msd','site1',site1,'msd','site2',site2,'mscd','pair',pair) as (metric,site,observed)")).withColumn("max_lag", lags.max_lag())
    got = curves.where("metric in ('msd','mscd')").groupBy("unit_id", "metric", "site").agg(F.count(F.lit(1)).alias("supported_lags"), F.max("pair_count").alias("most_pairs"))
    reason = (
        F.when(F.col("max_lag") < 1, "movie_too_short")
        .when(F.col("observed") == 0, "no_observations")
        .when(F.col("supported_lags").isNull(), "insufficient_valid_pairs_all_lags")
    )
    return grid.join(got, ["unit_id", "metric", "site"], "left").select(
        "unit_id", "metric", "site", "movie_frames", "max_lag", "observed", F.coalesce("supported_lags", F.lit(0)).alias("supported_lags"), "most_pairs",
        reason.isNull().alias("included"), reason.alias("reason"),
    )
