"""Coverage, missingness, cohorts, separation and motion diagnostics of bundles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.contracts import present
from trackloom.functions.numeric import bad_flag, ratio
from trackloom.operators.curves import kruskal, spearman
from trackloom.operators.lags import islands
from trackloom.session import written

# Thresholds of the nested trajectory cohorts.
PRIMARY = {"site1_valid_count": 20, "site2_valid_count": 20, "paired_valid_count": 20, "longest_paired_run": 10, "paired_coverage": 0.5}
RELAXED = {"site1_valid_count": 10, "site2_valid_count": 10, "paired_valid_count": 10, "longest_paired_run": 5}


def delivered_once(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key, the first loaded; null keys are left out. Combines map-side."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(*[F.min_by(present(c) if dict(df.dtypes)[c] == "double" else F.col(c), "loaded_at").alias(c) for c in columns if c not in keys])


def clean_bundles(bundle_metadata: DataFrame) -> DataFrame:
    keep = [c for c in bundle_metadata.columns if c not in ("loaded_at", "deleted_at")]
    return delivered_once(bundle_metadata, ["bundle_id"], keep).select(*keep)


def clean_frames(frame_table: DataFrame) -> DataFrame:
    """One row per bundle and frame of the site1/site2 naming, with flags and finite coordinates."""
    keep = ["acquisition_id", "fov_id", "cell_id", "bundle_id", "hour_post_delivery", "frame", "micro_time_s", "frame_interval_s", "paired_valid", "bp1_valid"]
    keep += [f"site{s}_{c}" for s in (1, 2) for c in ("x_nm", "y_nm", "valid")]
    return delivered_once(frame_table.where("site1_valid is not null"), ["bundle_id", "frame"], keep).select(*keep)


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & (F.abs(c) < float("inf"))


def bundle_summary(frames: DataFrame, bundles: DataFrame) -> DataFrame:
    """Counts, coverages of the nominal frames and longest consecutive runs, recomputed from the frames."""
    counted = frames.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("frame_rows"),
        *[F.count_if(F.col(f"{s}_valid")).alias(f"{s}_count") for s in ("site1", "site2", "paired")],
        F.count_if(F.coalesce("bp1_valid", F.lit(False))).alias("bp1_count"),
    )
    out = counted
    for s in ("site1", "site2", "paired"):
        out = out.join(islands(frames, ["bundle_id"], "frame", f"{s}_valid", f"longest_{s}"), "bundle_id", "left")
    out = out.join(bundles.select("bundle_id", F.col("nominal_frame_count").alias("nominal")), "bundle_id", "left")
    return out.withColumns({f"{s}_coverage": ratio(F.col(f"{s}_count").cast("double"), F.col("nominal")) for s in ("site1", "site2", "paired")})


def point_channel(frames: DataFrame, radius_nm: float | None = None) -> DataFrame:
    """Third channel per bundle: detections over evaluable frames, longest detected run, status; with its
    coordinates (bp1_x_nm, bp1_y_nm) and a radius also the frames near the pair midpoint."""
    seen = frames.where("bp1_valid is not null")
    n, k = F.count(F.lit(1)), F.count_if("bp1_valid")
    extra = []
    if radius_nm is not None:
        d = F.hypot(F.col("bp1_x_nm") - (F.col("site1_x_nm") + F.col("site2_x_nm")) / 2, F.col("bp1_y_nm") - (F.col("site1_y_nm") + F.col("site2_y_nm")) / 2)
        near = F.col("bp1_valid") & F.col("paired_valid")
        extra = [F.count_if(near & (d <= radius_nm)).alias("near_frames"), F.median(F.when(near, d)).alias("median_distance_nm")]
    out = seen.groupBy("bundle_id").agg(n.alias("evaluable_frames"), k.alias("detected_frames"), *extra)
    out = out.join(islands(seen, ["bundle_id"], "frame", "bp1_valid", "longest_detected_run"), "bundle_id")
    status = F.when(F.col("detected_frames") == 0, "not_detected").when(F.col("detected_frames") == F.col("evaluable_frames"), "always_detected").otherwise("detected")
    return out.withColumns({"detection_fraction": F.col("detected_frames") / F.col("evaluable_frames"), "status": status})


LEVELS = {"overall": [], "hour": ["hour_post_delivery"], "acquisition": ["acquisition_id"], "fov": ["acquisition_id", "fov_id"], "cell": ["acquisition_id", "fov_id", "cell_id"]}


def _sets(df: DataFrame, levels: Sequence[str], *measures: Column) -> DataFrame:
    """The nested levels in one pass by grouping sets; null keys form groups of their own."""
    names = list(dict.fromkeys(c for lv in levels for c in LEVELS[lv]))
    out = df.groupingSets([[F.col(c) for c in LEVELS[lv]] for lv in levels], *names).agg(*measures, F.grouping_id(*names).alias("_gid"))
    ids = {lv: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in LEVELS[lv]) for lv in levels}
    level = F.coalesce(*[F.when(F.col("_gid") == i, lv) for lv, i in ids.items()])
    return out.withColumn("level", level).drop("_gid")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        on = on & left[k].eqNullSafe(right[k])
    return left.join(right, on, "left").select(*[left[c] for c in left.columns], *[right[c] for c in right.columns if c not in keys])


def missingness_census(frames: DataFrame, bundles: DataFrame) -> DataFrame:
    """Coverage at five nested levels from the frames, with bundle medians joined null-safely."""
    levels = list(LEVELS)
    f = _sets(
        frames, levels, F.count(F.lit(1)).alias("frame_rows"),
        *[F.count_if(F.coalesce(F.col(f"{s}_valid"), F.lit(False))).alias(f"{s}_frames") for s in ("site1", "site2", "paired", "bp1")],
    )
    b = _sets(
        bundles, levels, F.count_distinct("bundle_id").alias("bundle_count"), F.median("paired_coverage").alias("median_paired_coverage"),
        F.median("longest_paired_run").alias("median_longest_paired_run"),
    )
    out = _null_safe(f, b, ["level", *LEVELS["hour"], *LEVELS["cell"]])
    return out.withColumns({f"{s}_coverage": F.col(f"{s}_frames") / F.col("frame_rows") for s in ("site1", "site2", "paired", "bp1")})


def missingness_asymmetry(frames: DataFrame) -> DataFrame:
    """Frames seen by one site only, by none, and the share of site 1 in the discordant ones."""
    a, b = F.coalesce("site1_valid", F.lit(False)), F.coalesce("site2_valid", F.lit(False))
    out = _sets(
        frames, ["overall", "hour", "acquisition"], F.count(F.lit(1)).alias("frame_rows"), F.count_if(a & ~b).alias("site1_only"), F.count_if(b & ~a).alias("site2_only"),
        F.count_if(~a & ~b).alias("both_missing"), (F.avg(a.cast("double")) - F.avg(b.cast("double"))).alias("site1_minus_site2"),
    )
    discordant = F.col("site1_only") + F.col("site2_only")
    return out.withColumns({"discordant": discordant, "site1_share": F.when(discordant > 0, F.col("site1_only") / discordant)})


def technical_hierarchy(bundles: DataFrame) -> DataFrame:
    q = lambda c, p, a: F.percentile(c, F.lit(p)).alias(a)
    share = lambda c, a: F.avg(c.cast("double")).alias(a)
    return bundles.groupBy("acquisition_id", "fov_id").agg(
        F.count_distinct("bundle_id").alias("bundle_count"), F.count_distinct("cell_id").alias("cell_count"),
        *[q(f"{s}_coverage", p, f"{s}_coverage_{n}") for s in ("site1", "site2", "paired") for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))],
        share((F.coalesce("site1_valid_count", F.lit(0)) > 0) & (F.coalesce("site2_valid_count", F.lit(0)) > 0), "both_sites_fraction"),
        share(F.coalesce("paired_valid_count", F.lit(0)) > 0, "any_paired_fraction"),
    )


def timing_hierarchy(frames: DataFrame) -> DataFrame:
    """Interval spread per acquisition, cells first, so that frames are no units of their own."""
    ok = frames.where(F.col("frame_interval_s").isNotNull() & (F.col("frame_interval_s") > 0) & (F.col("frame_interval_s") < float("inf")))
    i = "frame_interval_s"
    cell = ok.groupBy("acquisition_id", "fov_id", "cell_id").agg(F.median(i).alias("m"), F.min(i).alias("lo"), F.max(i).alias("hi"))
    out = cell.groupBy("acquisition_id", "fov_id").agg(F.count_distinct("cell_id").alias("cell_count"), F.median("m").alias("interval_median_s"), F.min("lo").alias("interval_min_s"), F.max("hi").alias("interval_max_s"))
    r = F.col("interval_max_s") / F.col("interval_min_s")
    return out.withColumns({"max_min_ratio": r, "ratio_gt_1_5": r > 1.5, "ratio_gt_2": r > 2.0})


def one_to_one(bundles: DataFrame, a: str = "acquisition_id", b: str = "fov_id") -> DataFrame:
    """Whether each a has one b and each b one a."""
    pairs = bundles.select(a, b).distinct()
    most = lambda x, y, n: pairs.groupBy(x).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias(n))
    return most(a, b, "most_b").join(most(b, a, "most_a"), F.lit(True)).select(((F.col("most_b") == 1) & (F.col("most_a") == 1)).alias("one_to_one"), "most_a", "most_b")


def sensitivity_grid(bundles: DataFrame, coverages: Sequence[float] = (0.4, 0.6, 0.8), paired: Sequence[int] = (10, 20, 30), runs: Sequence[int] = (5, 10, 20), base: int = 20) -> DataFrame:
    """Bundles included under each combination of thresholds: counted in one pass, one conditional count each."""
    ok = (F.col("site1_valid_count") >= base) & (F.col("site2_valid_count") >= base)
    grid = [(c, p, r) for c in coverages for p in paired for r in runs]
    counts = [
        F.struct(F.lit(float(c)).alias("min_coverage"), F.lit(p).alias("min_paired"), F.lit(r).alias("min_run"), F.count_if(ok & (F.col("paired_coverage") >= c) & (F.col("paired_valid_count") >= p) & (F.col("longest_paired_run") >= r)).alias("included"))
        for c, p, r in grid
    ]
    one = bundles.agg(F.count(F.lit(1)).alias("eligible"), F.array(*counts).alias("grid"))
    return one.select("eligible", F.explode("grid").alias("g")).select("g.*", "eligible", F.when(F.col("eligible") > 0, F.col("g.included") / F.col("eligible")).alias("inclusion_fraction"))


def fails(thresholds: dict[str, float]) -> dict[str, Column]:
    """Failure of each rule; a missing value fails."""
    return {c: F.coalesce(F.col(c) < t, F.lit(True)) for c, t in thresholds.items()}


def primary_cohort(bundles: DataFrame, thresholds: dict[str, float] = PRIMARY) -> DataFrame:
    """bundles with included and the reasons of exclusion, joined by |."""
    rules = fails(thresholds)
    reasons = F.concat_ws("|", *[F.when(f, c) for c, f in rules.items()])
    return bundles.withColumn("reasons", reasons).withColumn("included", F.col("reasons") == "")


def cohort_flow(cohort: DataFrame, thresholds: dict[str, float] = PRIMARY) -> DataFrame:
    """Exclusions per rule (a bundle counts under each), in total and by hour and acquisition, null hours kept."""
    reason = cohort.where("not included").withColumn("reason", F.explode(F.split("reasons", r"\|")))
    total = reason.groupBy("reason").count().select(F.lit("total").alias("flow"), "reason", F.lit(None).cast("double").alias("hour_post_delivery"), F.lit(None).cast("string").alias("acquisition_id"), F.col("count").alias("bundles"))
    by = reason.groupBy("reason", "hour_post_delivery", "acquisition_id").count().select(F.lit("by_hour_acquisition").alias("flow"), "reason", "hour_post_delivery", "acquisition_id", F.col("count").alias("bundles"))
    overall = cohort.groupBy("included").count().select(F.lit("overall").alias("flow"), F.when(F.col("included"), "included").otherwise("excluded").alias("reason"), F.lit(None).cast("double").alias("hour_post_delivery"), F.lit(None).cast("string").alias("acquisition_id"), F.col("count").alias("bundles"))
    return overall.unionByName(total).unionByName(by)


def tiers(bundles: DataFrame, frames: DataFrame) -> DataFrame:
    """Size of the four views: shared frames, frames of each site, relaxed and strict trajectory cohorts (nested)."""
    views = [("T1", "shared", frames.where("paired_valid")), *[("T2", s, frames.where(f"{s}_valid")) for s in ("site1", "site2")]]
    t3, t4 = primary_cohort(bundles, RELAXED).where("included"), primary_cohort(bundles).where("included")
    views += [(t, n, frames.join(c.select("bundle_id"), "bundle_id", "left_semi")) for t, n, c in (("T3", "relaxed", t3), ("T4", "strict", t4))]
    rows = [v.agg(F.lit(t).alias("tier"), F.lit(n).alias("cohort"), F.count(F.lit(1)).alias("frames"), F.count_distinct("bundle_id").alias("bundles"), F.count_distinct("acquisition_id").alias("acquisitions")) for t, n, v in views]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def tier_violations(bundles: DataFrame) -> DataFrame:
    """Bundles in the strict cohort that are not in the relaxed one: must be empty."""
    return primary_cohort(bundles).where("included").join(primary_cohort(bundles, RELAXED).where("included").select("bundle_id"), "bundle_id", "left_anti")


def channels_long(frames: DataFrame) -> DataFrame:
    """Valid flags of the channels as rows."""
    return frames.select("bundle_id", "frame", F.expr("stack(3, 'site1', site1_valid, 'site2', site2_valid, 'bp1', bp1_valid) as (channel, valid)"))


def shared_separation(frames: DataFrame) -> DataFrame:
    """Frames on which both sites are valid and finite, with their distance."""
    ok = F.col("site1_valid") & F.col("site2_valid")
    for c in ("site1_x_nm", "site1_y_nm", "site2_x_nm", "site2_y_nm"):
        ok = ok & finite(c)
    dx, dy = F.col("site2_x_nm") - F.col("site1_x_nm"), F.col("site2_y_nm") - F.col("site1_y_nm")
    return frames.where(ok).withColumn("separation_nm", F.sqrt(dx * dx + dy * dy))


def separation_summary(shared: DataFrame, threshold_nm: float = 550.0, keys: Sequence[str] = ()) -> DataFrame:
    s = F.col("separation_nm")
    q = lambda p, a: F.percentile(s, F.lit(p)).alias(a)
    return shared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count_distinct("bundle_id").alias("bundles"), F.count_if(s > threshold_nm).alias("above"),
        (F.lit(100.0) * F.count_if(s > threshold_nm) / F.count(F.lit(1))).alias("percent_above"), F.median(s).alias("median_nm"), q(0.25, "q25_nm"), q(0.75, "q75_nm"), F.max(s).alias("max_nm"),
    )


def separation_histogram(shared: DataFrame, width_nm: float = 50.0, threshold_nm: float = 550.0, keys: Sequence[str] = ()) -> DataFrame:
    """Equal bins from 0 to the first edge strictly above the largest distance of all; empty bins are kept. The
    threshold group follows the left edge, so a distance equal to the threshold falls above it here."""
    counted = shared.groupBy(*keys, F.floor(F.col("separation_nm") / width_nm).alias("bin")).count()
    last = counted.agg(F.max("bin").alias("last"))
    total = counted.groupBy(*keys).agg(F.sum("count").alias("total")) if keys else counted.agg(F.sum("count").alias("total"))
    grid = total.join(F.broadcast(last), F.lit(True)).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    out = grid.join(counted, [*keys, "bin"], "left").withColumn("frames", F.coalesce("count", F.lit(0)))
    return out.select(
        *keys, (F.col("bin") * width_nm).alias("bin_left_nm"), "frames", (F.col("frames") / F.col("total")).alias("probability"),
        F.when(F.col("bin") * width_nm >= threshold_nm, "above").otherwise("at_or_below").alias("side"),
    )


def separation_runs(shared: DataFrame, width_nm: float = 50.0, threshold_nm: float = 550.0, keys: Sequence[str] = ()) -> DataFrame:
    """separation_histogram over every distance: one row per occurring bin, and one per run of empty bins between
    them (at most two where the run holds the threshold), so that far distances cost nothing. Null keys form a
    group of their own."""
    counted = written(shared.groupBy(*keys, F.floor(F.col("separation_nm") / width_nm).alias("bin")).count())
    end = counted.select(*keys).distinct().join(F.broadcast(counted.agg((F.max("bin") + 1).alias("bin"))), F.lit(True))
    group = Window.partitionBy(*keys)
    start = F.coalesce(F.lag("bin").over(group.orderBy("bin")) + 1, F.lit(0))
    marked = counted.unionByName(end, allowMissingColumns=True).withColumns({"start": start, "total": F.sum("count").over(group)})
    cut = F.lit(math.ceil(threshold_nm / width_nm)).cast("long")
    piece = lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.alias("frames"))
    none = F.lit(0).cast("long")
    pieces = F.array(piece(F.col("start"), F.least("bin", cut), none), piece(F.greatest("start", cut), F.col("bin"), none), piece(F.col("bin"), F.col("bin") + F.when(F.col("count").isNotNull(), 1).otherwise(0), F.col("count")))
    out = marked.select(*keys, "total", F.explode(pieces).alias("p")).where("p.b > p.a")
    left = F.col("p.a") * width_nm
    return out.select(
        *keys, left.alias("bin_left_nm"), (F.col("p.b") * width_nm).alias("bin_right_nm"), "p.frames", (F.col("p.frames") / F.col("total")).alias("probability"),
        F.when(left >= threshold_nm, "above").otherwise("at_or_below").alias("side"),
    )


def threshold_sweep(shared: DataFrame, low: int = 400, high: int = 1000, step: int = 25, key: str = "hour_post_delivery") -> DataFrame:
    """Share of frames above each threshold per hour: one pass, one conditional count per threshold."""
    values = list(range(low, high + 1, step))
    s = F.col("separation_nm")
    one = shared.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"), F.array(*[F.struct(F.lit(float(t)).alias("threshold_nm"), F.count_if(s > t).alias("above")) for t in values]).alias("sweep")
    )
    return one.select(key, "frames", F.explode("sweep").alias("w")).select(key, "w.threshold_nm", "frames", "w.above", (F.lit(100.0) * F.col("w.above") / F.col("frames")).alias("percent_above"))


def shape_candidates(sweep: DataFrame, peak: float, late: Sequence[float], rounding: float = 50.0, key: str = "hour_post_delivery") -> DataFrame:
    """Thresholds on the rounding grid at which the share rises strictly up to the peak hour and stays lower at
    the late hours, best drop first."""
    grid = sweep.where(F.col("threshold_nm") % rounding == 0)
    along = Window.partitionBy("threshold_nm").orderBy(key)
    step = grid.withColumn("up", F.when(F.col(key) <= peak, F.col("percent_above") > F.lag("percent_above").over(along)))
    at = lambda h: F.max(F.when(F.col(key) == h, F.col("percent_above")))
    shape = step.groupBy("threshold_nm").agg(F.min(F.coalesce("up", F.lit(True))).alias("rises"), at(peak).alias("peak"), *[at(h).alias(f"late{i}") for i, h in enumerate(late)], F.min_by("percent_above", key).alias("first"))
    ok = F.col("rises") & F.col("peak").isNotNull()
    for i in range(len(late)):
        ok = ok & (F.col(f"late{i}") < F.col("peak"))
    drop = F.col("peak") - F.col(f"late{len(late) - 1}")
    return shape.select("threshold_nm", F.coalesce(ok, F.lit(False)).alias("shape_ok"), (F.col("peak") - F.col("first")).alias("rise"), drop.alias("drop"))


def complete_pairs(frames: DataFrame, movies: DataFrame, least_frames: Sequence[int] = ()) -> DataFrame:
    """Bundles seen on every frame of the movie by both sites, with statistics of their separation and both global
    ranks (ties by bundle_id). least_frames: movie lengths that are left out."""
    shared = shared_separation(frames)
    s = F.col("separation_nm")
    per = shared.groupBy("bundle_id").agg(
        F.min("acquisition_id").alias("acquisition_id"), F.min("hour_post_delivery").alias("hour_post_delivery"), F.count(F.lit(1)).alias("shared_frames"), F.avg(s).alias("mean_nm"),
        F.stddev_samp(s).alias("sd_nm"), F.median(s).alias("median_nm"), F.min(s).alias("min_nm"), F.max(s).alias("max_nm"),
    )
    full = per.join(movies, "acquisition_id").where((F.col("movie_frames") > 0) & (F.col("shared_frames") == F.col("movie_frames")))
    if least_frames:
        full = full.where(~F.col("movie_frames").isin(*least_frames))
    return full


def with_ranks(df: DataFrame, value: str, key: str = "bundle_id") -> DataFrame:
    """Global ranks from both ends. One sort of a table of one row per case."""
    up, down = Window.orderBy(F.round(value, 9), key), Window.orderBy(F.desc(F.round(value, 9)), key)
    return df.withColumns({"shortest_rank": F.row_number().over(up), "longest_rank": F.row_number().over(down)})


def pair_gallery(frames: DataFrame, members: DataFrame) -> DataFrame:
    """Order of pairs by the RMS of both sites' radii of gyration over shared frames, within the hour. Centring on
    the pooled mean does not change a radius, which is the spread about the site's own mean."""
    shared = shared_separation(frames).join(members.select("bundle_id"), "bundle_id", "left_semi")
    rg2 = lambda s: F.var_pop(F.col(f"site{s}_x_nm") / 1000) + F.var_pop(F.col(f"site{s}_y_nm") / 1000)
    per = shared.groupBy("bundle_id").agg(F.min("hour_post_delivery").alias("hour_post_delivery"), F.count(F.lit(1)).alias("paired_frames"), F.sqrt(rg2(1)).alias("site1_rg_um"), F.sqrt(rg2(2)).alias("site2_rg_um"))
    per = per.withColumn("rg_rms_um", F.sqrt((F.col("site1_rg_um") * F.col("site1_rg_um") + F.col("site2_rg_um") * F.col("site2_rg_um")) / 2))
    return per.withColumn("gallery_rank", F.row_number().over(Window.partitionBy("hour_post_delivery").orderBy(F.round("rg_rms_um", 9), "bundle_id")))


def aligned_frames(frames: DataFrame, members: DataFrame) -> DataFrame:
    """Shared frames of the members, in micrometres about the pooled mean of both sites."""
    shared = shared_separation(frames).join(members.select("bundle_id"), "bundle_id", "left_semi")
    w = Window.partitionBy("bundle_id")
    out = {}
    for a in "xy":
        middle = F.avg((F.col(f"site1_{a}_nm") + F.col(f"site2_{a}_nm")) / 2).over(w)
        out |= {f"site{s}_{a}_um": (F.col(f"site{s}_{a}_nm") - middle) / 1000 for s in (1, 2)}
    return shared.withColumns(out).select("bundle_id", "frame", *out)


def step_speeds(frames: DataFrame) -> DataFrame:
    """Speed between consecutive frames of either site and of their midpoint (speed_site1, speed_site2, speed_paired), the
    separation, and whether each is valid on the next frame. One window pass."""
    along = Window.partitionBy("bundle_id").orderBy("frame")
    dt = F.col("micro_time_s") - F.lag("micro_time_s").over(along)
    follows = (F.col("frame") - F.lag("frame").over(along) == 1) & (dt > 0) & (dt < float("inf"))
    valid = {f"site{s}": F.coalesce(f"site{s}_valid", F.lit(False)) for s in (1, 2)}
    here = {f"site{s}": valid[f"site{s}"] & finite(f"site{s}_x_nm") & finite(f"site{s}_y_nm") for s in (1, 2)}
    at = {f"site{s}": (F.col(f"site{s}_x_nm"), F.col(f"site{s}_y_nm")) for s in (1, 2)}
    valid["paired"], here["paired"] = valid["site1"] & valid["site2"], here["site1"] & here["site2"]
    at["paired"] = tuple((at["site1"][i] + at["site2"][i]) / 2 for i in (0, 1))
    across = [at["site2"][i] - at["site1"][i] for i in (0, 1)]
    out = {
        "has_next": F.coalesce(F.lead("frame").over(along) - F.col("frame") == 1, F.lit(False)),
        "separation": F.when(here["paired"], F.sqrt(across[0] * across[0] + across[1] * across[1])),
    }
    for s, (x, y) in at.items():
        dx, dy = x - F.lag(x).over(along), y - F.lag(y).over(along)
        out[f"speed_{s}"] = F.when(follows & here[s] & F.lag(here[s]).over(along), F.sqrt(dx * dx + dy * dy) / dt)
        out[f"next_{s}"] = F.coalesce(F.lead(valid[s]).over(along), F.lit(False))
    return frames.withColumns(out)


MOTION = ("site1", "site2", "paired")


def motion_coverage(speeds: DataFrame, bundles: DataFrame, least_steps: int = 5, least_cells: int = 5) -> DataFrame:
    """Spearman correlation, over the cells of an acquisition, of coverage and median speed, for either site and for
    the midpoint of the pair."""
    parts = [F.struct(F.lit(s).alias("channel"), F.count(f"speed_{s}").alias("steps"), F.median(f"speed_{s}").alias("speed")) for s in MOTION]
    per = speeds.groupBy("bundle_id").agg(F.array(*parts).alias("m")).select("bundle_id", F.inline("m"))
    covered = bundles.select("bundle_id", "acquisition_id", "cell_id", F.expr(f"stack(3, {', '.join(f"'{s}', {s}_coverage" for s in MOTION)}) as (channel, covered)"))
    own = per.where((F.col("steps") >= least_steps) & F.col("speed").isNotNull()).join(covered, ["bundle_id", "channel"]).where("covered is not null")
    cell = own.groupBy("channel", "acquisition_id", "cell_id").agg(F.avg("covered").alias("coverage"), F.median("speed").alias("speed"))
    # values equal up to rounding are ties
    cell = cell.select("channel", "acquisition_id", F.round("coverage", 9).alias("coverage"), F.round("speed", 9).alias("speed"))
    return spearman(cell, ["channel", "acquisition_id"], "coverage", "speed").where(F.col("n") >= least_cells)


def track_loss(speeds: DataFrame, quantile: float = 0.75, least_cells: int = 5) -> DataFrame:
    """Risk of losing a channel on the next frame after a fast step (the sites) or a large separation (the pair):
    within-cell difference of the share lost between predictors at or over the acquisition's quantile and the others,
    averaged over cells that have both."""
    predictor = {"site1": "speed_site1", "site2": "speed_site2", "paired": "separation"}
    rows = ", ".join(f"'{s}', {c}, next_{s}" for s, c in predictor.items())
    events = speeds.where("has_next").select("acquisition_id", "cell_id", F.expr(f"stack(3, {rows}) as (channel, value, kept)"))
    events = events.where("value is not null").withColumn("lost", (~F.col("kept")).cast("double"))
    keys = ["channel", "acquisition_id"]
    limit = events.groupBy(*keys).agg(F.percentile("value", F.lit(quantile)).alias("limit"))
    cells = (
        events.join(limit, keys)
        .groupBy(*keys, "cell_id")
        .agg(F.avg(F.when(F.col("value") >= F.col("limit"), F.col("lost"))).alias("high"), F.avg(F.when(F.col("value") < F.col("limit"), F.col("lost"))).alias("low"))
    )
    both = cells.where("high is not null and low is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.avg("high").alias("h"), F.avg("low").alias("l"), F.avg(F.col("high") - F.col("low")).alias("d"), F.median(F.col("high") - F.col("low")).alias("m")
    )
    ok = F.col("cells") >= least_cells
    analysis = F.when(F.col("channel") == "paired", "loss_after_large_separation").otherwise("loss_after_high_speed")
    return both.select(analysis.alias("analysis"), *keys, "cells", *[F.when(ok, F.col(a)).alias(b) for a, b in (("h", "risk_high"), ("l", "risk_reference"), ("d", "mean_difference"), ("m", "median_difference"))], ok.alias("supported"))


def motion_summary(coverage: DataFrame, loss: DataFrame) -> DataFrame:
    """Both diagnostics over the acquisitions: how many were assessed and supported, and the median, least and largest
    effect of the supported ones."""
    one = coverage.select(F.lit("coverage_against_motion").alias("analysis"), "channel", F.col("rho").alias("effect"), F.col("rho").isNotNull().alias("ok"))
    two = loss.select("analysis", "channel", F.col("mean_difference").alias("effect"), (F.col("supported") & F.col("mean_difference").isNotNull()).alias("ok"))
    effect = F.when(F.col("ok"), F.col("effect"))
    return one.unionByName(two).groupBy("analysis", "channel").agg(
        F.count(F.lit(1)).alias("assessed"), F.count_if("ok").alias("supported"), F.median(effect).alias("median_effect"), F.min(effect).alias("least_effect"), F.max(effect).alias("largest_effect")
    )


def bundle_asymmetry(bundles: DataFrame) -> DataFrame:
    """Difference of the two sites' coverages per bundle, signed and absolute."""
    off = F.col("site1_coverage") - F.col("site2_coverage")
    return bundles.select("bundle_id", "acquisition_id", "hour_post_delivery", off.alias("coverage_difference"), F.abs(off).alias("absolute_difference"))


def coverage_associations(bundles: DataFrame) -> DataFrame:
    """Kruskal-Wallis over acquisitions of the cells' mean coverages."""
    cell = bundles.groupBy("acquisition_id", "fov_id", "cell_id").agg(*[F.round(F.avg(f"{s}_coverage"), 12).alias(f"{s}_coverage") for s in ("site1", "site2", "paired")])
    long = cell.select("acquisition_id", F.expr("stack(3,'site1_coverage',site1_coverage,'site2_coverage',site2_coverage,'paired_coverage',paired_coverage) as (outcome,value)"))
    return kruskal(long, ["outcome"], "acquisition_id", "value")


def frame_intervals(frames: DataFrame) -> DataFrame:
    """Interval to the next frame; the last frame repeats the one before; a single frame keeps its own reading."""
    along = Window.partitionBy("bundle_id").orderBy("frame")
    t = F.col("micro_time_s")
    return frames.select("bundle_id", "frame", F.coalesce(F.lead(t).over(along) - t, t - F.lag(t).over(along), F.col("frame_interval_s")).alias("interval_s"))


def frame_issues(frame_table: DataFrame) -> DataFrame:
    """Violations of the frame table by code, with their number and an example key."""
    # rows without a bundle are no series; they are spread over many partitions
    series = F.coalesce("bundle_id", F.concat(F.lit("\0"), (F.xxhash64("frame", "micro_time_s") % 997).cast("string")))
    along = Window.partitionBy(series).orderBy("frame", "loaded_at")
    t = present("micro_time_s")
    gap = present("frame_interval_s")
    whole = Window.partitionBy(series)
    df = frame_table.withColumns(
        {
            "_t": t, "_before": F.lag(t).over(along), "_same": F.lag("frame").over(along), "_gap": F.lag(gap).over(along),
            "_first": F.row_number().over(along) == 1,
            **{f"_{c}": F.min(F.coalesce(c, F.lit(""))).over(whole) != F.max(F.coalesce(c, F.lit(""))).over(whole) for c in ("acquisition_id", "fov_id", "cell_id")},
        }
    )
    due = F.col("_gap") * (F.col("frame") - F.col("_same"))
    v1, v2 = F.coalesce("site1_valid", F.lit(False)), F.coalesce("site2_valid", F.lit(False))
    x = lambda s: present(f"site{s}_x_nm").isNotNull() & present(f"site{s}_y_nm").isNotNull()
    known = F.col("bundle_id").isNotNull()
    codes = {
        "missing_bundle_id": ~known,
        "missing_frame": F.col("frame").isNull(),
        "missing_time": t.isNull(),
        "negative_time": t < 0,
        "duplicate_key": known & (F.col("_same") == F.col("frame")),
        "time_not_increasing": known & (F.col("_same") < F.col("frame")) & (t <= F.col("_before")),
        "valid_without_coordinates": (v1 & ~x(1)) | (v2 & ~x(2)),
        "pair_flag_disagrees": F.col("site1_valid").isNotNull() & (F.coalesce("paired_valid", F.lit(False)) != (v1 & v2)),
        "invalid_flag": bad_flag(F.col("site1_valid")) | bad_flag(F.col("site2_valid")),
        "missing_hour": present("hour_post_delivery").isNull(),
        "invalid_hour": present("hour_post_delivery").isNotNull() & ~(present("hour_post_delivery").between(0, 1e6)),
        "invalid_frame": F.col("frame") < 0,
        "invalid_frame_interval": gap.isNull() | ~((gap > 0) & (gap < float("inf"))),
        "frame_interval_mismatch": known & (F.col("_same") < F.col("frame")) & (F.abs(t - F.col("_before") - due) > 1e-6 + 0.05 * F.abs(due)),
        **{f"blank_{c}": F.col(c).isNull() | (F.trim(c) == "") for c in ("biological_experiment_id", "acquisition_id", "fov_id", "cell_id")},
        **{f"bundle_crosses_{c}": known & F.col("_first") & F.col(f"_{c}") for c in ("acquisition_id", "fov_id", "cell_id")},
    }
    key = F.concat_ws("#", F.coalesce("bundle_id", F.lit("")), F.coalesce(F.col("frame").cast("string"), F.lit("")))
    return _issues(df, codes, key)


def _issues(df: DataFrame, codes: dict[str, Column], key: Column) -> DataFrame:
    """One pass: conditional counts and least keys of all codes, as rows; codes without violation are left out."""
    rows = [F.struct(F.lit(c).alias("code"), F.count_if(F.coalesce(v, F.lit(False))).alias("violations"), F.min(F.when(v, key)).alias("example")) for c, v in codes.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("violations > 0")


def bundle_issues(bundle_metadata: DataFrame) -> DataFrame:
    """Violations of the bundle table by code."""
    n = F.col("nominal_frame_count")
    c = {s: F.col(f"{s}_valid_count") for s in ("site1", "site2", "paired")}
    cov = {s: present(f"{s}_coverage") for s in ("site1", "site2", "paired")}
    off = [F.abs(cov[s] - c[s] / n) > 1e-9 for s in c]
    codes = {
        "missing_bundle_id": F.col("bundle_id").isNull(),
        "blank_cell_id": F.col("cell_id").isNull() | (F.trim("cell_id") == ""),
        "count_over_nominal": (c["site1"] > n) | (c["site2"] > n) | (c["paired"] > n),
        "paired_over_site": c["paired"] > F.least(c["site1"], c["site2"]),
        "coverage_outside_unit": F.coalesce(*[F.when((v < 0) | (v > 1), True) for v in cov.values()], F.lit(False)),
        "coverage_disagrees": F.coalesce(*[F.when(o, True) for o in off], F.lit(False)),
        "missing_hour": present("hour_post_delivery").isNull(),
    }
    return _issues(bundle_metadata, codes, F.coalesce("bundle_id", F.lit("")))


def reconciliation(frames: DataFrame, bundles: DataFrame) -> DataFrame:
    """Ids on one side only and counts that disagree between the frame and the bundle table."""
    counted = frames.groupBy("bundle_id").agg(*[F.count_if(f"{s}_valid").alias(f"{s}_seen") for s in ("site1", "site2", "paired")], F.min("acquisition_id").alias("acquisition_seen"))
    both = counted.withColumn("f", F.lit(True)).join(bundles.withColumn("b", F.lit(True)), "bundle_id", "full_outer")
    known = F.col("f").isNotNull() & F.col("b").isNotNull()
    codes = {
        "bundle_without_metadata": F.col("b").isNull(),
        "bundle_without_frames": F.col("f").isNull(),
        **{f"{s}_count_disagrees": known & (F.col(f"{s}_seen") != F.col(f"{s}_valid_count")) for s in ("site1", "site2", "paired")},
        "acquisition_disagrees": known & (F.col("acquisition_seen") != F.col("acquisition_id")),
    }
    return _issues(both, codes, F.col("bundle_id"))


def half_width(aligned: DataFrame) -> DataFrame:
    """Shared display half width: the largest absolute coordinate, up to the next quarter."""
    most = F.greatest(*[F.max(F.abs(c)) for c in ("site1_x_um", "site1_y_um", "site2_x_um", "site2_y_um")])
    return aligned.agg((F.ceil(most * 4) / 4).alias("half_width_um"))


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))
