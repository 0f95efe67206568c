"""Frames that arrive as a stream: repeats dropped and coverage counted, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_deliveries(frames: DataFrame, late: str = "2 days") -> DataFrame:
    """The first delivery of every (bundle_id, frame) among those within `late` of each other. State: keys seen
    within the watermark."""
    return frames.withColumn("arrived", F.col("loaded_at").cast("timestamp")).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["bundle_id", "frame"])


def coverage_by_day(frames: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows, and rows with each site valid, per acquisition and day of loading."""
    timed = frames.withColumn("arrived", F.col("loaded_at").cast("timestamp")).withWatermark("arrived", late)
    return timed.groupBy(F.window("arrived", "1 day").alias("day"), "acquisition_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.coalesce("site1_valid", F.lit(False))).alias("site1_frames"), F.count_if(F.coalesce("paired_valid", F.lit(False))).alias("paired_frames")
    )
