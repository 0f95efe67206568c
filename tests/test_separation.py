"""Distances of all sizes in the histogram and the hour means."""

import duckdb
from pathlib import Path

from test_queries import rows

import __spark_entry__ as entry
from trackloom.operators.cohorts import separation_runs


def test_far_distances_are_counted_in_runs(spark):
    near, far = [(1.0, x) for x in (10.0, 60.0, 560.0, 560.0, 9.9e8)], [(None, 549.0)]
    found = separation_runs(spark.createDataFrame(near + far, "h double, separation_nm double"), keys=["h"])
    got = {(r.h, r.bin_left_nm): (r.bin_right_nm, r.frames, r.side) for r in found.collect()}
    assert sum(n for _, n, _ in got.values()) == 6 and len(got) == 9
    assert got[1.0, 100.0] == (550.0, 0, "at_or_below") and got[1.0, 600.0] == (9.9e8, 0, "above") and got[1.0, 9.9e8][1] == 1
    assert got[None, 0.0] == (500.0, 0, "at_or_below") and got[None, 500.0] == (550.0, 1, "at_or_below") and got[None, 550.0] == (9.9e8 + 50, 0, "above")


def test_every_shared_frame_counts(spark, data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    each = "select bundle_id, frame, coalesce(site1_valid, site_left_valid) and coalesce(site2_valid, site_right_valid) as valid, coalesce(site1_x_nm, site_left_x_nm) + coalesce(site1_y_nm, site_left_y_nm) + coalesce(site2_x_nm, site_right_x_nm) + coalesce(site2_y_nm, site_right_y_nm) as sum from frame_table"
    every = con.execute(f"select count(*) from (select distinct bundle_id, frame from ({each}) where valid and isfinite(sum) and bundle_id is not null and frame is not null)").fetchone()[0]
    for name in ("s_histogram", "s_hour_statistics"):
        df = entry.queries()[name](spark, data)
        out = df.collect()
        if name == "s_histogram":
            assert sum(r.frames for r in out) == every
        result = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert rows(df.columns, out) == rows(names, result.fetchall())
