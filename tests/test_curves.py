import math

import numpy as np
import pytest

from trackloom.functions import numeric
from pyspark.sql import functions as fn

from trackloom.operators import cube, curves, resampling
from pyspark.sql import functions as F


def test_bins_are_half_open_and_zero_is_its_own(spark):
    edges = numeric.bin_edges([1.0, 4.0, 16.0])
    assert edges == [0.5, 2.0, 8.0, 32.0]
    df = spark.createDataFrame([(x,) for x in (0.0, 0.49, 0.5, 1.99, 2.0, 31.9, 32.0)], "x double")
    assert [r[0] for r in df.select(numeric.lag_bin(F.col("x"), [1.0, 4.0, 16.0])).collect()] == [0.0, None, 1.0, 1.0, 4.0, 16.0, None]
    assert df.where("x = 2.0").select(numeric.nearest_center(F.col("x"), [1.0, 3.0, 9.0])).first()[0] == 1.0


def test_flags_and_areas(spark):
    df = spark.createDataFrame([(x,) for x in ("True", " yes ", "0", "n", "maybe", None)], "x string")
    got = [(r[0], r[1]) for r in df.select(numeric.flag(F.col("x")), numeric.bad_flag(F.col("x"))).collect()]
    assert got == [(True, False), (True, False), (False, False), (False, False), (None, True), (None, False)]


def test_power_fit_recovers_exponent(spark):
    rows = [("m", float(x), 0.01 * x**0.6, 24) for x in (10, 15, 20, 30, 40, 50)]
    df = spark.createDataFrame(rows, "metric string, x double, y double, n long")
    fit = curves.power_fits(df, ["metric"], "x", "y", "n").first()
    assert fit.exponent == pytest.approx(0.6, abs=1e-8) and fit.amplitude_at_1s == pytest.approx(0.01) and fit.r2_log == pytest.approx(1.0) and fit.span == 5.0


def test_spearman_kruskal_and_adjusted_p(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    df = spark.createDataFrame([("k", float(x), float(y)) for x, y in zip(a, b)], "k string, a double, b double")

    def rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    assert curves.spearman(df, ["k"], "a", "b").first().rho == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    h = curves.kruskal(df, ["k"], "a", "b").first()
    r, n = rank(b), 40
    q = sum(r[a == g].sum() ** 2 / (a == g).sum() for g in set(a.tolist()))
    ties = sum(k**3 - k for k in np.unique(b, return_counts=True)[1])
    assert h.kruskal_h == pytest.approx((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n**3 - n)))
    same = spark.createDataFrame([("k", 1.0, 5.0), ("k", 2.0, 5.0), ("k", 2.0, 5.0)], "k string, a double, b double")
    assert curves.kruskal(same, ["k"], "a", "b").first().kruskal_h is None and curves.spearman(same, ["k"], "a", "b").first().rho is None
    p = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.04, 0.03, None, 0.5])], "i int, p double")
    got = {r.i: r.p_bh for r in curves.benjamini_hochberg(p, "p", "i").collect()}
    assert got[3] is None and [got[i] for i in (0, 1, 2, 4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_fbm_fit_and_bootstrap(spark):
    rows = [("s", 1.0, f"c{c}", f"u{c}", float(x), float(resampling.fbm(np.array(x), 0.7)), 1.0) for c in range(6) for x in (0.5, 1.0, 1.5, 2.0, 2.5)]
    df = spark.createDataFrame(rows, "site string, hour double, crop string, unit string, x double, value double, weight double")
    assert resampling.fit_fbm(df, ["site", "hour"]).first().alpha == pytest.approx(0.7, abs=1e-4)
    b = resampling.bootstrap_fbm(df, ["site", "hour"], "crop", "unit", 30).first()
    assert b.clusters == 6 and b.low == pytest.approx(b.high, abs=1e-3) and b.alpha == pytest.approx(0.7, abs=1e-3)
    first, second = (sorted(map(tuple, resampling.bootstrap_means(df, ["site", "hour", "x"], "crop", "value", 100).collect())) for _ in range(2))
    assert first == second and all(abs(r[4] - r[5]) < 1e-12 and abs(r[4] - r[6]) < 1e-12 for r in first)
    one = resampling.cluster_bootstrap(df.where("crop = 'c1'"), ["site"], "crop", lambda t: float(t.value.mean()), 100, columns=["value"]).first()
    assert one.clusters == 1 and one.low is None
    with pytest.raises(ValueError):
        resampling.cluster_bootstrap(df, ["site"], "crop", len, 10)


def test_cube_is_exact_on_linear_functions_and_finds_tau(spark):
    a, r, x = np.meshgrid([0.25, 1.0], [-3.0, 3.0], [0.0, 5.0], indexing="ij")
    c = cube.Cube(np.array([0.25, 1.0]), np.array([-3.0, 3.0]), np.array([0.0, 5.0]), 0.1 * a + 0.2 * r + 0.3 * x)
    assert c.evaluate(0.5, 1.0, 2.0) == pytest.approx(0.85)
    with pytest.raises(ValueError):
        c.evaluate(0.5, 4.0, 2.0)
    rows = [(1.5, t, x, 0.05 + 0.2 * math.log10(t / 100) + 0.3 * x, t, 9) for t in (10.0, 20.0, 40.0) for x in (0.0, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "hour_post_delivery double, target_s double, center double, value double, delta_s double, units long")
    fit = cube.tau_search(df, c, 0.5).first()
    assert fit.tau_s == 100.0 and fit.r_squared == pytest.approx(1) and fit.rmse == pytest.approx(0, abs=1e-9) and fit.boundary is False
    assert cube.tau_search(df, c, 0.5, (1, 60)).first().boundary is True
    assert cube.tau_search(df.where("target_s = 10"), c, 0.5).first().tau_s is None
    units = df.withColumn("u", fn.explode(fn.sequence(fn.lit(1), fn.lit(10)))).withColumn("crop", (fn.col("u") % 3).cast("string"))
    b = cube.tau_bootstrap(units, c, 0.5, "crop", 20).first()
    assert (b.clusters, b.tau_s, b.low, b.high) == (3, 100.0, 100.0, 100.0)
    with pytest.raises(Exception, match="outside the cube"):
        cube.tau_search(df.withColumn("delta_s", fn.lit(1e6)), c, 0.5).collect()


def test_fbm_bootstrap_weighs_units_once(spark):
    """A unit of many offsets counts once, and bins weigh their units."""
    curve = lambda a, x: float(resampling.fbm(np.array(x), a))
    rows = [("s", f"c{u}", f"u{u}", x, curve(0.4, x)) for u in range(4) for x in (0.5, 1.0, 1.5, 2.0)]
    repeated = rows + [r for r in rows if r[2] == "u0"] * 5
    one, two = (resampling.bootstrap_fbm(spark.createDataFrame(x, "site string, crop string, unit string, x double, value double"), ["site"], "crop", "unit", 20).first() for x in (rows, repeated))
    assert tuple(one) == pytest.approx(tuple(two)) and one.alpha == pytest.approx(0.4, abs=1e-3)
    uneven = [("s", "c0", "u0", x, curve(0.4, x)) for x in (0.5, 1.0, 1.5, 2.0)] + [("s", f"c{u}", f"u{u}", 0.5, curve(0.9, 0.5)) for u in range(1, 40)]
    got = resampling.bootstrap_fbm(spark.createDataFrame(uneven, "site string, crop string, unit string, x double, value double"), ["site"], "crop", "unit", 20).first()
    x, y, w = np.array([0.5, 1.0, 1.5, 2.0]), np.array([(curve(0.4, 0.5) + 39 * curve(0.9, 0.5)) / 40, *[curve(0.4, v) for v in (1.0, 1.5, 2.0)]]), np.array([40, 1, 1, 1]) / 43
    grid = np.linspace(0.25, 1, 3001)
    best = grid[np.argmin([(w * (y - resampling.fbm(x, a)) ** 2).sum() for a in grid])]
    assert got.alpha == pytest.approx(best, abs=1e-3)


def test_dropout_is_reproducible(spark):
    df = spark.createDataFrame([("u", "s", i, float(i)) for i in range(10)], "unit_id string, site string, frame int, x double")
    one, two = (sorted(r.frame for r in resampling.empirical_dropout(df, 0.35, 3).collect()) for _ in range(2))
    assert one == two and len(one) == 7


def test_greedy_cases_do_not_repeat_a_bundle(spark):
    df = spark.createDataFrame([("a", "s1", 0.5), ("a", "s2", 0.52), ("b", "s1", 0.6)], "bundle_id string, site string, alpha double")
    got = curves.nearest_cases(df, [0.5, 0.51]).collect()
    assert [(r.bundle_id, r.site) for r in got] == [("a", "s1"), ("b", "s1")]
