"""Unit curves: lag bins, one point per unit and bin, equal-unit group curves, closed-form fits and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.contracts import nan_to_null
from trackloom.functions.numeric import fbm_vac, lag_bin, log_window_mean, nearest_center, ratio

# The published lag bin centers in seconds.
CENTERS_S = (1.0, 1.5, 2.0, 3.0, 5.0, 7.5, 10.0, 15.0, 20.0, 30.0, 40.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 500.0)


def clean_curves(unit_curves: DataFrame) -> DataFrame:
    """Finite values only, NaN elsewhere as null, repeated rows of a key reduced to one."""
    ok = nan_to_null(unit_curves).where(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    keys = ["metric", "unit_id", "lag_frames", "site", "direction", "delta_median_s"]
    rest = [c for c in ok.columns if c not in keys]
    best = ok.groupBy(*keys).agg(F.min(F.struct("value", "pair_count", *[c for c in rest if c not in ("value", "pair_count")])).alias("m"))
    return best.select(*keys, "m.*").select(*unit_curves.columns)


def primary_points(curves: DataFrame) -> DataFrame:
    """Displacement metrics, and velocity metrics of the primary matched offset."""
    return curves.where("metric in ('msd', 'mscd') or (metric in ('vac', 'vcc') and is_primary_matched_10s)")


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def unit_bins(curves: DataFrame, centers: Sequence[float] = CENTERS_S) -> DataFrame:
    """One point per unit and lag bin: nearest to the center in log lag, then most pairs, then smallest lag. VCC
    needs both directions of a bundle, whose points are averaged (counts take the smaller); the bundle is its unit."""
    binned = primary_points(curves).withColumn("bin_s", lag_bin(F.col("lag_median_s"), centers)).where("bin_s is not null")
    off = F.when(F.col("bin_s") > 0, F.abs(F.ln(F.col("lag_median_s") / F.col("bin_s")))).otherwise(F.lit(0.0))
    keys = ["metric", "unit_id", "hour_post_delivery", "site", "direction", "bin_s"]
    chosen = first_by(binned, keys, F.round(off, 12), F.desc("pair_count"), "lag_frames")
    columns = ["metric", "unit_id", "bundle_id", "nd2_id", "crop_id", "hour_post_delivery", "site", "bin_s"]
    values = ["lag_median_s", "scaled_lag_tau_over_delta", "delta_median_s", "value", "endpoint_pair_sd"]
    both = (
        chosen.where("metric = 'vcc'")
        .withColumn("unit_id", F.coalesce("bundle_id", "unit_id"))
        .groupBy(*columns)
        .agg(*[F.avg(c).alias(c) for c in values], F.min("pair_count").alias("pair_count"), F.min("lag_frames").alias("lag_frames"), F.count_distinct("direction").alias("ways"))
        .where("ways = 2")
        .drop("ways")
    )
    return chosen.where("metric <> 'vcc'").select(*columns, *values, "pair_count", "lag_frames").unionByName(both)


def matrix_bins(rows: DataFrame, centers: Sequence[float] = CENTERS_S) -> DataFrame:
    """Matrices in (site1, site2) order on the lag bins: per unit, direction, component and bin the row nearest to the
    center in log lag, then with most pairs, then of the smallest lag; both directions averaged where both exist."""
    from trackloom.operators.lags import symmetrise

    binned = rows.withColumn("bin_s", lag_bin(F.col("lag_s_median"), centers)).where("bin_s is not null and normalized_value is not null")
    off = F.when(F.col("bin_s") > 0, F.abs(F.ln(F.col("lag_s_median") / F.col("bin_s")))).otherwise(F.lit(0.0))
    keys = ["unit_id", "row_component", "column_component", "bin_s"]
    chosen = first_by(binned, [*keys, "direction"], F.round(off, 12), F.desc("pair_count"), "lag")
    return symmetrise(chosen, keys, ["lag_s_median", "normalized_value", "raw_value"])


def hour_curves(bins: DataFrame) -> DataFrame:
    """Equal-unit curves per metric, site, hour and bin with the units available at that hour. Null hours keep
    their curves but have no denominator."""
    group = ["metric", "site", "hour_post_delivery"]
    v = F.col("value")
    curves = bins.groupBy(*group, "bin_s").agg(
        F.avg("lag_median_s").alias("lag_s_mean"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"),
        F.percentile(v, F.lit(0.25)).alias("q25"), F.percentile(v, F.lit(0.75)).alias("q75"),
        F.count_distinct("unit_id").alias("n_units"), F.count_distinct("crop_id").alias("n_crops"), F.count_distinct("nd2_id").alias("n_acquisitions"), F.sum("pair_count").alias("total_pairs"),
    )
    available = bins.where("hour_post_delivery is not null").groupBy(*group).agg(F.count_distinct("unit_id").alias("available_units"))
    same = [curves[g].eqNullSafe(available[g]) for g in group]
    joined = curves.join(available, same[0] & same[1] & same[2], "left").select(*[curves[c] for c in curves.columns], available["available_units"])
    return joined.withColumn("retained_unit_fraction", F.col("n_units") / F.col("available_units"))


def scaled_bins(curves: DataFrame, centers: Sequence[float], keys: Sequence[str] = ("hour_post_delivery", "site", "unit_id", "delta_median_s")) -> DataFrame:
    """One point per unit, offset and scaled-lag center: nearest center (of equals the lower), then most pairs."""
    x = F.col("scaled_lag_tau_over_delta")
    binned = curves.where(x.isNotNull()).withColumn("center", nearest_center(x, centers))
    return first_by(binned, [*keys, "center"], F.round(F.abs(x - F.col("center")), 12), F.desc("pair_count"), "lag_frames")


def collapsed_curves(bins: DataFrame) -> DataFrame:
    """Offsets averaged within the unit first, then units within the hour."""
    unit = bins.groupBy("hour_post_delivery", "site", "unit_id", "center").agg(F.avg("value").alias("value"), F.sum("pair_count").alias("pair_count"))
    return unit.groupBy("hour_post_delivery", "site", "center").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n_units"), F.sum("pair_count").alias("total_pairs"))


def fine_curve(curves: DataFrame, width: float = 0.25, least_units: int = 3) -> DataFrame:
    """Display grid: bround(x / width) * width, the nearest point per unit, bins of enough units."""
    x = F.col("scaled_lag_tau_over_delta")
    grid = curves.where(x.isNotNull()).withColumn("grid", F.bround(x / width) * width)
    one = first_by(grid, ["hour_post_delivery", "site", "unit_id", "grid"], F.round(F.abs(x - F.col("grid")), 12), F.desc("pair_count"), "lag_frames", "value")
    return one.groupBy("hour_post_delivery", "site", "grid").agg(F.avg("value").alias("mean"), F.count_distinct("unit_id").alias("n_units")).where(F.col("n_units") >= least_units)


def power_fits(points: DataFrame, keys: Sequence[str], x: str, y: str, n: str) -> DataFrame:
    """Log-log power law per group in closed form: slope minimises sum n r^2; r2_log weights by sqrt(n)."""
    lx, ly, w = F.ln(x), F.ln(y), F.col(n).cast("double")
    ok = points.where((F.col(x) > 0) & (F.col(y) > 0) & (w > 0)).select(*keys, F.col(x).alias("_x"), lx.alias("lx"), ly.alias("ly"), w.alias("w"), F.sqrt(w).alias("r"))
    s = lambda c: F.sum(c)
    fit = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), (F.max("_x") / F.min("_x")).alias("span"),
        s("w").alias("w"), s(F.expr("w*lx")).alias("wx"), s(F.expr("w*ly")).alias("wy"), s(F.expr("w*lx*lx")).alias("wxx"), s(F.expr("w*lx*ly")).alias("wxy"),
        s("r").alias("r"), s(F.expr("r*lx")).alias("rx"), s(F.expr("r*ly")).alias("ry"), s(F.expr("r*lx*lx")).alias("rxx"), s(F.expr("r*lx*ly")).alias("rxy"), s(F.expr("r*ly*ly")).alias("ryy"),
    )
    slope = ratio(F.expr("w*wxy - wx*wy"), F.expr("w*wxx - wx*wx"))
    fit = fit.where("points >= 2").withColumn("exponent", slope).withColumn("intercept", F.expr("(wy - exponent*wx)/w"))
    left = F.expr("ryy - 2*intercept*ry - 2*exponent*rxy + intercept*intercept*r + 2*intercept*exponent*rx + exponent*exponent*rxx")
    total = F.expr("ryy - ry*ry/r")
    return fit.select(
        *keys, "points", "span", "exponent", F.exp("intercept").alias("amplitude_at_1s"), (F.exp("intercept") * F.pow(F.lit(10.0), "exponent")).alias("value_at_10s"),
        (1 - ratio(left, total)).alias("r2_log"),
    )


def trajectory_fits(msd: DataFrame, lower_s: float = 10.0, upper_s: float = 50.0, min_pairs: int = 8, min_points: int = 5, min_span: float = 4.0) -> DataFrame:
    """Power law of single trajectories in log10 with pair counts as weights, in fit and in r2."""
    keys = ["unit_id", "bundle_id", "nd2_id", "crop_id", "hour_post_delivery", "site"]
    ok = msd.where((F.col("lag_median_s") >= lower_s) & (F.col("lag_median_s") <= upper_s) & (F.col("value") > 0) & (F.col("pair_count") >= min_pairs))
    p = ok.select(*keys, "lag_median_s", F.log10("lag_median_s").alias("x"), F.log10("value").alias("y"), F.col("pair_count").cast("double").alias("w"))
    s = lambda e, a: F.sum(F.expr(e)).alias(a)
    fit = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_fit_lags"), F.min("lag_median_s").alias("fit_lag_min_s"), F.max("lag_median_s").alias("fit_lag_max_s"), F.sum("w").cast("long").alias("fit_endpoint_pairs"),
        s("w", "w"), s("w*x", "wx"), s("w*y", "wy"), s("w*x*x", "wxx"), s("w*x*y", "wxy"), s("w*y*y", "wyy"),
    )
    fit = fit.where((F.col("n_fit_lags") >= min_points) & (F.col("fit_lag_max_s") / F.col("fit_lag_min_s") >= min_span))
    alpha = ratio(F.expr("w*wxy - wx*wy"), F.expr("w*wxx - wx*wx"))
    fit = fit.withColumn("alpha", alpha).withColumn("c", F.expr("(wy - alpha*wx)/w"))
    left = F.expr("wyy - 2*c*wy - 2*alpha*wxy + c*c*w + 2*c*alpha*wx + alpha*alpha*wxx")
    total = F.expr("wyy - wy*wy/w")
    return fit.select(
        *keys, "alpha", F.pow(F.lit(10.0), "c").alias("amplitude_at_1s"), (1 - ratio(left, total)).alias("r2_log"), "n_fit_lags", "fit_lag_min_s", "fit_lag_max_s", "fit_endpoint_pairs",
        log_window_mean(F.pow(F.lit(10.0), "c"), F.col("alpha"), lower_s, upper_s).alias("window_mean"),
    )


def extremes(df: DataFrame, n: int, *order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The n first and n last rows in the order, with class and rank. Two top-n scans, no global sort."""
    up = df.orderBy(*order).limit(n)
    down = df.orderBy(F.desc(order[0]), *order[1:]).limit(n)
    place = lambda x, *o: x.withColumn("rank", F.row_number().over(Window.orderBy(*o)))
    return place(up, *order).withColumn("class", F.lit("lowest")).unionByName(place(down, F.desc(order[0]), *order[1:]).withColumn("class", F.lit("highest")))


def nearest_cases(fits: DataFrame, targets: Sequence[float], value: str = "alpha", key: str = "bundle_id") -> DataFrame:
    """Greedy: for each target in turn the nearest case whose key is not taken yet. Each target needs at most
    len(targets) candidates, so one top-k per target is enough."""
    rows = []
    for t in targets:
        near = fits.withColumn("distance", F.abs(F.col(value) - t)).orderBy(F.round("distance", 12), key, "site").limit(2 * len(targets) + 2)
        rows.append((t, near.select(key, "site", value, "distance").collect()))
    taken, picked = set(), []
    for t, near in rows:
        best = next((r for r in near if r[key] not in taken), None)
        if best is not None:
            taken.add(best[key])
            picked.append((float(t), best[key], best["site"], best[value], best["distance"]))
    return fits.sparkSession.createDataFrame(picked, f"target double, {key} string, site string, {value} double, distance double")


def near_lag_ranking(curves: DataFrame, n: int = 4, target: float = 10.0, low: float = 7.5, high: float = 12.5) -> DataFrame:
    """Largest values at the lag nearest to the target inside its window: nearest lag per unit, then top n."""
    inside = curves.where(F.col("lag_median_s").between(low, high))
    one = first_by(inside, ["unit_id"], F.round(F.abs(F.col("lag_median_s") - target), 12), F.desc("pair_count"), "lag_frames")
    return one.select("unit_id", "bundle_id", "lag_median_s", "value", "pair_count").orderBy(F.desc("value"), "unit_id").limit(n)


def hour_trend(fits: DataFrame, keys: Sequence[str], hour: str, value: str) -> DataFrame:
    """Spearman correlation of a fitted value with the hour (average ranks), for at least three hours."""
    return spearman(fits.where(F.col(hour).isNotNull() & F.col(value).isNotNull()), keys, hour, value).where("n >= 3")


def average_rank(column: str, keys: Sequence[str]) -> Column:
    """Rank with ties averaged, within the keys."""
    w = Window.partitionBy(*keys).orderBy(column)
    ties = Window.partitionBy(*keys, column)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """rho, n per group; null where a side is constant."""
    ranked = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_ra": average_rank(a, keys), "_rb": average_rank(b, keys)})
    moments = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp("_ra", "_rb").alias("c"), F.stddev_samp("_ra").alias("sa"), F.stddev_samp("_rb").alias("sb")
    )
    return moments.select(*keys, "n", ratio(F.col("c"), F.col("sa") * F.col("sb")).alias("rho"))


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction and epsilon squared per key."""
    ok = df.where(F.col(value).isNotNull())
    ranked = ok.withColumn("_r", average_rank(value, keys))
    ties = ok.groupBy(*keys, value).count().groupBy(*keys).agg(F.sum(F.pow("count", F.lit(3)) - F.col("count")).alias("ties"))
    per = ranked.groupBy(*keys, group).agg(F.sum("_r").alias("s"), F.count(F.lit(1)).alias("m"))
    total = per.groupBy(*keys).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q")).join(ties, list(keys))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    able = (F.col("groups") >= 2) & (n > F.col("groups")) & (F.col("ties") < n * n * n - n)
    out = total.withColumn("kruskal_h", F.when(able, h))
    epsilon = F.greatest(F.lit(0.0), (F.col("kruskal_h") - F.col("groups") + 1) / (n - F.col("groups")))
    return out.select(*keys, "n", "groups", "kruskal_h", F.when(F.col("kruskal_h").isNotNull(), epsilon).alias("epsilon_squared"))


def benjamini_hochberg(df: DataFrame, p: str, *ties: str, out: str = "p_bh") -> DataFrame:
    """Benjamini-Hochberg adjusted p values over all rows of a report (a few rows per test); null p stays null."""
    ok = F.col(p).isNotNull()
    n = F.sum(F.when(ok, 1).otherwise(0)).over(Window.partitionBy())
    place = F.row_number().over(Window.partitionBy(ok).orderBy(p, *ties))
    step = df.withColumns({"_n": n, "_k": place}).withColumn("_a", F.when(ok, F.col(p) * F.col("_n") / F.col("_k")))
    down = Window.partitionBy(ok).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return step.withColumn(out, F.when(ok, F.least(F.lit(1.0), F.min("_a").over(down)))).drop("_n", "_k", "_a")


def zero_crossing(curves: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """First x at which y is zero or changes sign, by linear interpolation; null if it never does. The last point
    alone does not count as a crossing."""
    along = Window.partitionBy(*keys).orderBy(x)
    px, py = F.lag(x).over(along), F.lag(y).over(along)
    crossing = F.when(py == 0, px).when(py * F.col(y) < 0, px - py * (F.col(x) - px) / (F.col(y) - py))
    return curves.withColumn("_c", crossing).groupBy(*keys).agg(F.min("_c").alias("zero_crossing"))


def correlation_endpoints(bins: DataFrame) -> DataFrame:
    """Endpoints of each unit's cross-correlation up to five offsets, as rows (hour, crop, unit, endpoint, value): the
    value at zero lag; for at least three points over at least three offsets the trapezoid area of its positive
    part (of the points, without the exact crossing) and the first zero crossing; and the mean from three on."""
    keys = ["hour_post_delivery", "crop_id", "unit_id"]
    own = bins.where("metric = 'vcc' and scaled_lag_tau_over_delta between 0 and 5").select(*keys, F.col("scaled_lag_tau_over_delta").alias("x"), F.col("value").alias("y"))
    along = Window.partitionBy(*keys).orderBy("x")
    step = own.withColumns({"nx": F.lead("x").over(along), "ny": F.lead("y").over(along)})
    plus = lambda c: F.greatest(c, F.lit(0.0))
    crossing = F.when(F.col("ny").isNull(), None).when(F.col("y") == 0, F.col("x")).when(F.col("y") * F.col("ny") < 0, F.col("x") - F.col("y") * (F.col("nx") - F.col("x")) / (F.col("ny") - F.col("y")))
    per = step.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("span"), F.max(F.when(F.abs("x") < 1e-6, F.col("y"))).alias("zero"),
        F.sum((plus(F.col("y")) + plus(F.col("ny"))) / 2 * (F.col("nx") - F.col("x"))).alias("area"), F.min(crossing).alias("crossing"), F.avg(F.when(F.col("x") >= 3, F.col("y"))).alias("late"),
    )
    wide = (F.col("n") >= 3) & (F.col("span") >= 3)
    per = per.withColumns({"area": F.when(wide, F.col("area")), "crossing": F.when(wide, F.col("crossing"))})
    return per.select(*keys, F.expr("stack(4,'zero_lag_trace',zero,'positive_auc',area,'first_zero_crossing',crossing,'late_mean',late) as (endpoint,value)")).where("value is not null")


def fbm_rmse(points: DataFrame, alphas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted RMSE of curve points (x, value, weight) against the fBM curve at each group's alpha."""
    r = F.col("value") - fbm_vac(F.col("x"), F.col("alpha"))
    return points.join(alphas, list(keys)).groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * r * r) / F.sum("weight")).alias("rmse"), F.count(F.lit(1)).alias("points"))


def clustered_hour_means(df: DataFrame, hour: str, cluster: str, value: str) -> DataFrame:
    """Mean per hour with the standard error of a regression on hour dummies clustered by `cluster`, with the
    usual small-sample factor G/(G-1) * (N-1)/(N-K); clusters lie within hours."""
    ok = df.where(F.col(value).isNotNull() & F.col(hour).isNotNull())
    cl = ok.groupBy(hour, cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("m"))
    per = cl.groupBy(hour).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("clusters"), (F.sum("s") / F.sum("m")).alias("mean"))
    meat = cl.join(per.select(hour, "mean"), hour).groupBy(hour).agg(F.sum(F.pow(F.col("s") - F.col("m") * F.col("mean"), 2)).alias("meat"))
    every = Window.partitionBy()
    g, n, k = F.sum("clusters").over(every), F.sum("n").over(every), F.count(F.lit(1)).over(every)
    out = per.join(meat, hour).withColumns({"factor": (g / (g - 1)) * ((n - 1) / (n - k))})
    return out.select(hour, "n", "clusters", "mean", F.sqrt(F.col("meat") / (F.col("n") * F.col("n")) * F.col("factor")).alias("se"))
