"""The bundle-frame master: observations of each site joined losslessly into one row per bundle and frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.contracts import ContractError, require_columns, require_unique

SITES = ("site1", "site2", "53bp1_spt")
IDENTITY = ("cohort", "nd2_id", "crop_id", "fov_id", "hour_post_delivery", "allele_index")


def observed_wide(points: DataFrame) -> DataFrame:
    """One row per bundle and frame with the coordinates of every site: one shuffle instead of a chain of outer
    joins. A site seen twice in a frame, or identities or times that disagree between sites, are errors."""
    require_columns(points, ["bundle_id", "frame", "site_id", "x_nm", "y_nm", "time_s", *IDENTITY], "points")
    at = lambda s, c: F.max(F.when(F.col("site_id") == s, F.col(c)))
    wide = points.groupBy("bundle_id", "frame").agg(
        *[at(s, c).alias(f"{s}_{c}") for s in SITES for c in ("x_nm", "y_nm")],
        *[F.count_if(F.col("site_id") == s).alias(f"{s}_n") for s in SITES],
        *[F.max(c).alias(c) for c in IDENTITY],
        *[F.count_distinct(c).alias(f"{c}_ways") for c in IDENTITY],
        F.max("time_s").alias("time_s"),
        (F.max("time_s") - F.min("time_s")).alias("time_spread"),
    )
    bad = F.col("time_spread") > 1e-9
    for s in SITES:
        bad = bad | (F.col(f"{s}_n") > 1)
    for c in IDENTITY:
        bad = bad | (F.col(f"{c}_ways") > 1)
    found = wide.where(bad).select("bundle_id", "frame").limit(5).collect()
    if found:
        raise ContractError(f"observations disagree: {[tuple(r) for r in found]}")
    return wide.drop(*[f"{s}_n" for s in SITES], *[f"{c}_ways" for c in IDENTITY], "time_spread")


def frame_master(points: DataFrame, locus_frames: DataFrame) -> DataFrame:
    """Observations joined with the third channel's frames (bundle_id, frame, time_s, bp1_valid), no row of either
    lost; times must agree. Flags, micrometres and the separation of the sites are added."""
    require_unique(locus_frames, ["bundle_id", "frame"], "locus frames")
    locus = locus_frames.select("bundle_id", "frame", F.col("time_s").alias("locus_time_s"), "bp1_valid")
    both = observed_wide(points).join(locus, ["bundle_id", "frame"], "full_outer")
    off = both.where(F.abs(F.col("time_s") - F.col("locus_time_s")) > 1e-9).select("bundle_id", "frame").limit(5).collect()
    if off:
        raise ContractError(f"times disagree: {[tuple(r) for r in off]}")
    seen = {s: F.col(f"{s}_x_nm").isNotNull() & F.col(f"{s}_y_nm").isNotNull() for s in ("site1", "site2")}
    dx, dy = F.col("site2_x_nm") - F.col("site1_x_nm"), F.col("site2_y_nm") - F.col("site1_y_nm")
    return both.withColumns(
        {
            "time_s": F.coalesce("time_s", "locus_time_s"),
            **{f"{s}_valid": v for s, v in seen.items()},
            "shared": seen["site1"] & seen["site2"],
            **{f"{s}_{a}_um": F.col(f"{s}_{a}_nm") / 1000 for s in seen for a in "xy"},
            "separation_nm": F.sqrt(dx * dx + dy * dy),
        }
    ).drop("locus_time_s")


def bundle_index(master: DataFrame, alleles: DataFrame) -> DataFrame:
    """The allele index with the points of each bundle, 0 where none was seen. alleles has one row per bundle."""
    require_unique(alleles, ["bundle_id"], "alleles")
    counts = master.groupBy("bundle_id").agg(F.count_if("site1_valid").alias("site1_points"), F.count_if("site2_valid").alias("site2_points"), F.count_if("shared").alias("shared_site_frames"))
    return alleles.join(counts, "bundle_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("site1_points", "site2_points", "shared_site_frames")})
