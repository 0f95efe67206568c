"""Bundle frames: the cleaned fact table that every kernel starts from, and pair-mode projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.contracts import present


def coordinate(c: str, valid: str) -> Column:
    """Micrometres where the site is valid and the nanometres are finite, else null."""
    v = present(c)
    return F.when(F.col(valid) & (F.abs(v) < float("inf")), v / 1000)


def bundle_frames(frame_table: DataFrame, acquisition_index: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """unit_id, nd2_id, crop_id, hour, frame, movie_frames, time_s, x1, y1, x2, y2 - one row per unit and frame.

    Of rows delivered again the first loaded counts; null bundle or frame and frames outside 1..movie_frames
    are left out. time_s is the acquisition's clock: the median time of all its bundles at that frame. A
    point with one missing component is missing as a whole. clock: acquisition_clock of the frame table, if made already.
    """
    one = (
        frame_table.where("bundle_id is not null and frame is not null and site1_valid is not null")
        .groupBy("bundle_id", "frame")
        .agg(
            F.min("acquisition_id").alias("nd2_id"),
            F.min("cell_id").alias("crop_id"),
            F.min(present("hour_post_delivery")).alias("hour"),
            F.min_by("micro_time_s", "loaded_at").alias("own_time"),
            *[
                F.min_by(coordinate(f"site{s}_{a}_nm", f"site{s}_valid"), "loaded_at").alias(f"{a}{s}")
                for s in (1, 2)
                for a in "xy"
            ],
        )
    )
    movies = acquisition_index.groupBy("nd2_id").agg(F.max("movie_frames").cast("int").alias("movie_frames"))
    placed = one.join(movies, "nd2_id").where((F.col("frame") >= 1) & (F.col("frame") <= F.col("movie_frames")))
    clock = acquisition_clock(frame_table) if clock is None else clock
    whole = lambda s, a: F.when(F.col(f"x{s}").isNotNull() & F.col(f"y{s}").isNotNull(), F.col(f"{a}{s}")).alias(f"{a}{s}")
    return placed.join(clock, ["nd2_id", "frame"]).select(
        F.col("bundle_id").alias("unit_id"),
        "nd2_id",
        "crop_id",
        "hour",
        F.col("frame").cast("int").alias("frame"),
        "movie_frames",
        "time_s",
        *[whole(s, a) for s in (1, 2) for a in "xy"],
    )


def acquisition_clock(frame_table: DataFrame) -> DataFrame:
    """(nd2_id, frame, time_s): the median time per acquisition and frame of the plausible times."""
    t = present("micro_time_s")
    return (
        frame_table.where((t >= 0) & F.col("acquisition_id").isNotNull())
        .groupBy(F.col("acquisition_id").alias("nd2_id"), "frame")
        .agg(F.median(t).alias("time_s"))
    )


def site_points(frames: DataFrame) -> DataFrame:
    """One row per unit, site and observed frame: x, y."""
    keep = ["unit_id", "nd2_id", "crop_id", "hour", "frame", "movie_frames", "time_s"]
    return frames.select(*keep, F.expr("stack(2, 'site1', x1, y1, 'site2', x2, y2) as (site, x, y)")).where("x is not null")


def paired_points(frames: DataFrame) -> DataFrame:
    """Relative vector site2 - site1 where both are observed, as site 'pair'."""
    both = frames.where("x1 is not null and x2 is not null")
    return both.select(
        "unit_id", "nd2_id", "crop_id", "hour", "frame", "movie_frames", "time_s",
        F.lit("pair").alias("site"), (F.col("x2") - F.col("x1")).alias("x"), (F.col("y2") - F.col("y1")).alias("y"),
    )


def pair_modes(frames: DataFrame) -> DataFrame:
    """Common mode (midpoint), relative mode, separation and validity; null where either site is missing."""
    valid = F.col("x1").isNotNull() & F.col("x2").isNotNull()
    on = lambda c: F.when(valid, c)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return frames.select(
        "unit_id",
        "frame",
        valid.alias("valid"),
        on((F.col("x1") + F.col("x2")) / 2).alias("common_x"),
        on((F.col("y1") + F.col("y2")) / 2).alias("common_y"),
        on(dx).alias("relative_x"),
        on(dy).alias("relative_y"),
        on(F.sqrt(dx * dx + dy * dy)).alias("separation"),
    )


def motion_energy(frames: DataFrame, a: tuple[str, str] = ("x1", "y1"), b: tuple[str, str] = ("x2", "y2")) -> DataFrame:
    """Common and differential energy of two vectors: .5|a+b|^2 and .5|a-b|^2, whose sum is |a|^2 + |b|^2."""
    sq = lambda p, q: p * p + q * q
    ax, ay, bx, by = (F.col(c) for c in (*a, *b))
    common, differential = sq(ax + bx, ay + by) / 2, sq(ax - bx, ay - by) / 2
    total = common + differential
    return frames.withColumns(
        {
            "common_energy": common,
            "differential_energy": differential,
            "total_energy": total,
            "coherent_fraction": F.when(total > 0, common / total),
            "identity_residual": total - sq(ax, ay) - sq(bx, by),
        }
    )


def aggregate_coherent_fraction(energies: DataFrame, *keys: str) -> DataFrame:
    total = F.sum("total_energy")
    return energies.groupBy(*keys).agg(F.when(total > 0, F.sum("common_energy") / total).alias("coherent_fraction"))
