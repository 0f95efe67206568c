"""Queries on rows of both naming schemes."""

import shutil
from pathlib import Path

import duckdb
import pytest
from test_queries import rows

import __spark_entry__ as entry
from trackloom.sources.tables import NAMINGS

NAMES = "k_mscd k_vcc_matrix q_bundle_summary q_primary_cohort q_tiers g_gallery v_frame_issues v_reconciliation".split()


@pytest.fixture(scope="module")
def mixed(data, tmp_path_factory):
    """The test tables with every second bundle under the left/right names."""
    out = tmp_path_factory.mktemp("mixed")
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        names = NAMINGS.get(p.stem)
        if not names:
            shutil.copy(p, out)
            continue
        own = [f"case when hash(bundle_id) % 2 = 1 then {a} end as {a}, case when hash(bundle_id) % 2 = 0 then {a} else {b} end as {b}" for a, b in names.items()]
        con.execute(f"copy (select * replace ({', '.join(own)}) from '{p}') to '{out / p.name}' (format parquet)")
    left = con.execute(f"select count(site_left_valid), count(site1_valid) from '{out}/frame_table.parquet'").fetchone()
    assert min(left) > 0
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_names_make_no_difference(spark, data, mixed, name):
    """A query on mixed names equals the query on the same rows under one name, and its own SQL."""
    found = entry.queries()[name](spark, mixed)
    got = rows(found.columns, found.collect())
    plain = entry.queries()[name](spark, data)
    assert got == rows(plain.columns, plain.collect())
    con = duckdb.connect()
    for p in Path(mixed).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert got == rows(names, result.fetchall())
