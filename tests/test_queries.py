"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from trackloom.plans import cohort_queries, kernels, quality, summaries

NAMES = "p2_found p4_found k_mscd k_vcc_matrix k_directed_bursts u_matched_delta a_hour_curves f_trajectory_fits q_missingness_census q_track_loss s_histogram g_gallery v_reconciliation".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(str(plain(r[i])) for i in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = [n for m in (quality, kernels, summaries, cohort_queries) for n in m.QUERIES]
    assert len(own) == len(set(own)) and set(own) <= set(entry.queries())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
