import datetime as dt
import itertools
import json

from pyspark.sql import functions as F

from trackloom.operators.schema_drift import STEP, changes, consistent_table, edit_script

SCHEMA = "feed_id string, file_id string, table_name string, exported_at timestamp, received_at timestamp, line_no long, payload string, values string"


def raw(spark, files, table="frame_table"):
    rows = []
    for n, (file_id, records) in enumerate(files):
        at = dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
        rows += [("f", file_id, table, at, at, i, r if isinstance(r, str) or r is None else json.dumps(r), "clash") for i, r in enumerate(records)]
    return spark.createDataFrame(rows[::-1], SCHEMA)


def run(spark, *files):
    return sorted(tuple(r)[1:] for r in changes(raw(spark, files)).collect())


def rec(i, **fields):
    return {"bundle_id": f"b{i}", "frame": i, **fields}


def test_rename_needs_agreement_everywhere(spark):
    a = ("a", [rec(i, x=i * 1.5, y=i) for i in range(5)])
    assert run(spark, a, ("b", [rec(i, z=i * 1.5, y=i) for i in range(3, 8)])) == [("b", "renamed", "x", "z")]
    assert run(spark, a, ("b", [rec(i, z=i * 1.5 + (i == 4), y=i) for i in range(3, 8)])) == [("b", "added", "", "z"), ("b", "removed", "x", "")]
    # no record in common proves nothing
    assert run(spark, a, ("b", [rec(i, z=i * 1.5, y=i) for i in range(9, 12)])) == [("b", "added", "", "z"), ("b", "removed", "x", "")]


def test_left_out_and_null_are_one_and_text_forms_are_equal(spark):
    a = ("a", [rec(1, x=True, n=2.0), rec(2, x=False, n=3.0), rec(3, n=None)])
    b = ("b", [rec(1, X="true", m="2"), rec(2, X=0, m="3.0"), rec(3, X=None)])
    assert run(spark, a, b) == [("b", "renamed", "n", "m"), ("b", "renamed", "x", "X"), ("b", "retyped", "n", "m"), ("b", "retyped", "x", "X")]


def test_types(spark):
    a = rec(1, k=1, m=1, n=1, t="1", o=True)
    b = rec(1, k=1.0, m=7.0, n=None, t=1, o=False)
    assert run(spark, ("a", [a, rec(2, m=2.5)]), ("b", [b])) == [("b", "retyped", "k", "k"), ("b", "retyped", "t", "t")]


def test_bad_lines_order_repeats_and_empty(spark):
    a = ("z", [rec(1, x=1), rec(1, x=1), '{"bundle_id": "b2", "frame": 2, "q"', None, "[1]", "7", '{"a": NaN}', '{"bundle_id": "\\ud800", "u": "\\ud800"}'])
    got = run(spark, a, ("y", [rec(1, x=1, w="x" * 100_000)]), ("x", ["{"]))
    assert got == [("y", "added", "", "w"), ("y", "removed", "u", "")]
    assert run(spark) == []
    assert run(spark, ("a", [None])) == []


def test_nested_fields_and_moves(spark):
    a = ("a", [rec(i, pos={"x": i * 1.1, "y": i * 2.2}, q=i) for i in range(4)])
    b = ("b", [rec(i, place={"x": i * 1.1, "y": i * 2.2}, q=i) for i in range(4)])
    c = ("c", [rec(i, place={"y": i * 2.2}, x=i * 1.1, q=i) for i in range(4)])
    assert run(spark, a, b, c) == [("b", "renamed", "pos.x", "place.x"), ("b", "renamed", "pos.y", "place.y"), ("c", "renamed", "place.x", "x")]


def test_script_cost_is_least():
    """Against all assignments of flat fields: as few steps as possible, equal pairs only where proven."""
    for old, new in [("abc", "bxy"), ("abcd", "wxyz"), ("", "ab"), ("ab", "")]:
        gone, born = sorted(set(old) - set(new)), sorted(set(new) - set(old))
        for k in range(len(gone) * len(born) + 1):
            for proven in itertools.islice(itertools.combinations(itertools.product(gone, born), k), 40):
                best = max((sum(p in proven for p in zip(gone, perm)) for perm in itertools.permutations([*born, *" " * len(gone)], len(gone))), default=0)
                script = edit_script(list(old), list(new), proven)
                assert sum(c == "renamed" for c, _, _ in script) == best and len(script) == len(gone) + len(born) - best
                assert all((o, n) in proven for c, o, n in script if c == "renamed")


def test_consistent_table_follows_names_through_files(spark):
    files = [("a", [rec(i, x=i * 1.5, k="p") for i in range(4)]), ("b", [rec(i, z=i * 1.5, k="p") for i in range(2, 6)]), ("c", [rec(i, w=i * 1.5, k="p", x=i) for i in range(4, 8)])]
    t = {r["bundle_id"]: r for r in consistent_table(raw(spark, files), "frame_table").collect()}
    assert [t[f"b{i}"]["x"] for i in range(8)] == [i * 1.5 for i in range(8)]
    assert t["b7"]["x__2"] == 7 and t["b0"]["x__2"] is None and len(t) == 8


def test_feeds_of_both_namings_share_columns(spark):
    one = raw(spark, [("a", [rec(1, site1_x_nm=1.5)])])
    two = raw(spark, [("b", [rec(1, site_left_x_nm=2.5)])]).withColumn("feed_id", F.lit("g"))
    t = consistent_table(one.unionByName(two), "frame_table")
    assert t.columns == ["feed_id", "bundle_id", "frame", "site1_x_nm"] and {r.feed_id: r.site1_x_nm for r in t.collect()} == {"f": 1.5, "g": 2.5}
    counts = raw(spark, [("a", [{"bundle_id": "b", "longest_left_run": 3, "right_coverage": 0.5, "left_valid_count": 4}])], "bundle_metadata")
    assert consistent_table(counts, "bundle_metadata").columns[3:] == ["longest_site1_run", "site1_valid_count", "site2_coverage"]


def test_values_of_dropped_fields_and_records_without_key_stay(spark):
    files = [("a", [rec(1, x=1.5, k="p"), rec(2, x=2.5, k="q"), {"frame": 1, "k": "u"}, {"frame": 1, "k": "v"}, {"bundle_id": "b9", "k": "w"}]), ("b", [rec(1, k="r"), rec(2, k=None), {"bundle_id": "b9", "k": "y"}])]
    t = consistent_table(raw(spark, files), "frame_table").collect()
    assert {r.bundle_id: (r.x, r.k) for r in t if r.bundle_id in ("b1", "b2")} == {"b1": (1.5, "r"), "b2": (2.5, "q")}
    assert sorted(r.k for r in t if r.bundle_id is None or r.frame is None) == ["u", "v", "w", "y"]


def test_paths_keep_dots_apart():
    assert edit_script(["a.b"], [f"a{STEP}b"], [("a.b", f"a{STEP}b")]) == [("renamed", "a.b", f"a{STEP}b")]


def test_columns_take_the_widest_type_of_their_values(spark):
    files = [("a", [rec(i, b=i % 2 == 0, n=i, d=i, t="x", m=i, w="7") for i in range(4)]), ("b", [rec(i + 4, b=1, n=str(i), d=i + 0.5, t=3, m="none", w="8") for i in range(2)])]
    t = consistent_table(raw(spark, files), "frame_table")
    kinds = dict(t.dtypes)
    assert {k: kinds[k] for k in "bndtmw"} == {"b": "boolean", "n": "bigint", "d": "double", "t": "string", "m": "string", "w": "string"} and kinds["frame"] == "bigint"
    row = {r.bundle_id: r for r in t.collect()}
    assert row["b4"].b is True and row["b1"].b is False and row["b5"].n == 1 and row["b4"].d == 0.5 and row["b4"].t == "3"
