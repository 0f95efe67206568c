"""Sources, sinks, the frame master, cohorts, contracts and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from trackloom import contracts
from trackloom.operators import cohorts, frame_master
from trackloom.sources import files, sinks, tables
from trackloom.streaming import arrivals

POINTS = "bundle_id string, frame long, site_id string, x_nm double, y_nm double, time_s double, cohort string, nd2_id string, crop_id string, fov_id string, hour_post_delivery double, allele_index long"


def point(frame, site, x, y, crop="c"):
    return ("b", frame, site, x, y, float(frame), "k", "n", crop, "f", 1.0, 1)


def test_frame_master_keeps_every_row(spark):
    p = spark.createDataFrame([point(0, "site1", 0.0, 0.0), point(0, "site2", 300.0, 400.0), point(1, "site1", 1.0, 1.0)], POINTS)
    locus = spark.createDataFrame([("b", 0, 0.0, True), ("b", 2, 2.0, False)], "bundle_id string, frame long, time_s double, bp1_valid boolean")
    m = {r.frame: r for r in frame_master.frame_master(p, locus).collect()}
    assert len(m) == 3 and m[0].separation_nm == 500.0 and m[1].separation_nm is None and m[2].time_s == 2.0 and not m[2].site1_valid
    alleles = spark.createDataFrame([("b",), ("none",)], "bundle_id string")
    i = {r.bundle_id: r for r in frame_master.bundle_index(frame_master.frame_master(p, locus), alleles).collect()}
    assert (i["b"].site1_points, i["b"].site2_points, i["b"].shared_site_frames, i["none"].site1_points) == (2, 1, 1, 0)
    for bad in ([point(0, "site1", 0.0, 0.0)] * 2, [point(0, "site1", 0.0, 0.0), point(0, "site2", 0.0, 0.0, "other")]):
        with pytest.raises(contracts.ContractError):
            frame_master.observed_wide(spark.createDataFrame(bad, POINTS))


def test_publish_refuses_verifies_and_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("n1", 1), ("n2", 2), (None, None)], "nd2_id string, v int")
    target = str(tmp_path / "out")
    manifest = sinks.publish({"t": df}, target, {"t": ["nd2_id"]})
    assert json.loads((tmp_path / "out/manifest.json").read_text())["t"]["rows"] == 3
    back = spark.read.parquet(f"{target}/t.parquet").select("nd2_id", "v")
    assert sinks.verify(back, manifest["t"]) and not sinks.verify(back.where("v = 1"), manifest["t"])
    with pytest.raises(FileExistsError):
        sinks.publish({"t": df}, target)
    with pytest.raises(Exception):
        sinks.publish({"t": df.withColumn("x", F.raise_error(F.lit("no")).cast("string"))}, str(tmp_path / "bad"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    loaded = tables.load_table(spark, {"t": f"{target}/t.parquet"}, "t", ["v"], [("v", ">=", 2), ("nd2_id", "!=", "n1")])
    assert [r.v for r in loaded.collect()] == [2]
    with pytest.raises(KeyError):
        tables.load_table(spark, {}, "t")
    with pytest.raises(ValueError):
        tables.load_table(spark, {"t": f"{target}/t.parquet"}, "t", filters=[("v", "~", 2)])


def test_text_sources(spark, tmp_path):
    (tmp_path / "crop_R_a001.csv").write_text("frame,x_nm,y_nm\n1,2.5,3\n2,,4\n")
    (tmp_path / "crop_P_a012.csv").write_text("frame,x_nm,y_nm\n")
    (tmp_path / "notes.csv").write_text("frame,x_nm,y_nm\n9,9,9\n")
    got = files.with_identity(files.read_trajectories(spark, str(tmp_path))).orderBy("frame").collect()
    assert [(r.frame, r.x_nm, r.site_id, r.allele_index) for r in got] == [(1, 2.5, "site1", 1), (2, None, "site1", 1)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x_R_a001.csv").write_text("frame,x_nm,y_nm\n1,two,3\n")
    with pytest.raises(Exception):
        files.read_trajectories(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "e.tsv").write_text("")
    assert files.read_tsv(spark, str(tmp_path / "e.tsv"), "a string, b int").count() == 0


def test_hour_map_and_exact_times(spark, tmp_path):
    kind = "nd2_id string, fov_id string, hour double, source string"
    rows = [(" m1.nd2 ", "f", 2.0, "note"), ("m1", "f", 2.0, "note2"), ("m2", "f", 3.0, "inferred: name")]
    assert {r.nd2_id: r.hour for r in files.hour_map(spark.createDataFrame(rows, kind)).collect()} == {"m1": 2.0, "m2": None}
    with pytest.raises(contracts.ContractError):
        files.hour_map(spark.createDataFrame([*rows, ("m1", "f", 4.0, "note")], kind))
    (tmp_path / "a.json").write_text(json.dumps({"nd2_id": "a", "n_frames": 2, "finterval_s": 9.0, "time": {"relative_time_s": [0, 1.5, 3]}}))
    (tmp_path / "b.json").write_text(json.dumps({"nd2_id": "b", "n_frames": 2, "finterval_s": 9.0}))
    got = sorted((r.nd2_id, r.frame, r.time_s) for r in files.exact_times(spark, str(tmp_path)).collect())
    assert got == [("a", 1, 0.0), ("a", 2, 1.5), ("a", 3, 3.0), ("b", 1, 0.0), ("b", 2, 9.0)]
    (tmp_path / "c.json").write_text(json.dumps({"nd2_id": "c", "time": {"relative_time_s": [0, 2, 2]}}))
    with pytest.raises(contracts.ContractError):
        files.exact_times(spark, str(tmp_path))


def test_contracts(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0)], "k int, v double")
    with pytest.raises(contracts.ContractError):
        contracts.require_unique(df, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["z"])
    assert [r.v for r in contracts.nan_to_null(df).collect()] == [None, 2.0]
    with pytest.raises(contracts.ContractError):
        contracts.join_checked(df, df, ["k"])


B = "bundle_id string, acquisition_id string, cell_id string, hour_post_delivery double, site1_valid_count long, site2_valid_count long, paired_valid_count long, longest_paired_run long, paired_coverage double"


def test_cohorts_reasons_and_nesting(spark):
    rows = [("pass", "a", "c", None, 20, 20, 20, 10, 0.5), ("low", "a", "c", 1.0, 19, 20, 20, 10, 0.4), ("null", "a", "c", 1.0, None, 20, 20, 10, None)]
    df = spark.createDataFrame(rows, B)
    got = {r.bundle_id: (r.included, r.reasons) for r in cohorts.primary_cohort(df).collect()}
    assert got == {"pass": (True, ""), "low": (False, "site1_valid_count|paired_coverage"), "null": (False, "site1_valid_count|paired_coverage")}
    assert cohorts.tier_violations(df).count() == 0
    flow = {(r.flow, r.reason, r.hour_post_delivery): r.bundles for r in cohorts.cohort_flow(cohorts.primary_cohort(df)).collect()}
    assert flow["overall", "included", None] == 1 and flow["total", "paired_coverage", None] == 2
    assert cohorts.sensitivity_grid(df).count() == 27


S = "bundle_id string, acquisition_id string, hour_post_delivery double, frame long, site1_valid boolean, site2_valid boolean, site1_x_nm double, site1_y_nm double, site2_x_nm double, site2_y_nm double"


def test_separation_threshold_is_strict_in_the_summary_only(spark):
    df = spark.createDataFrame([("b", "a", 1.0, i, True, True, 0.0, 0.0, float(d), 0.0) for i, d in enumerate([100, 250, 499, 501, 750, 1200, 500])] + [("b", "a", 1.0, 9, None, True, 0.0, 0.0, 9.0, 0.0)], S)
    shared = cohorts.shared_separation(df)
    s = cohorts.separation_summary(shared, 500.0).first()
    assert (s.frames, s.above) == (7, 3)
    hist = {r.bin_left_nm: r for r in cohorts.separation_histogram(shared, 50.0, 500.0).collect()}
    assert max(hist) == 1200.0 and hist[500.0].frames == 2 and hist[500.0].side == "above" and hist[450.0].frames == 1 and hist[600.0].frames == 0
    assert sum(r.frames for r in hist.values()) == 7


def test_stream_drops_repeats_and_counts_days(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/frame_table.parquet").select("bundle_id", "frame", "acquisition_id", "site1_valid", "paired_valid", "loaded_at").where("bundle_id is not null")
    rows.limit(400).union(rows.limit(400)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("single", arrivals.single_deliveries(stream, "4000 days"), "append"), ("days", arrivals.coverage_by_day(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    kept = spark.table("single")
    assert kept.count() == kept.select("bundle_id", "frame").distinct().count() == rows.limit(400).select("bundle_id", "frame").distinct().count()
    assert spark.table("days").agg(F.sum("frames")).first()[0] == 800
