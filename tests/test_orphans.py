import datetime as dt

from trackloom.operators.orphans import encode_keys, orphan_references

T = lambda s: dt.datetime.fromisoformat(s) if s else None
REFS = "relation string, ref_key string, loaded_at timestamp, period string"
PARENTS = "relation string, ref_key string, loaded_at timestamp, deleted_at timestamp, kind string"


def run(spark, refs, parents):
    r = spark.createDataFrame([("t", k, T(x), "clash") for k, x in refs], REFS)
    p = spark.createDataFrame([("t", k, T(a), T(b), "clash") for k, a, b in parents], PARENTS)
    return sorted(tuple(x) for x in orphan_references(r, p).collect())


def brute(refs, parents):
    out = set()
    for k, x in refs:
        if k is None:
            continue
        own = [p for p in parents if p[0] == k]
        period = x[:7] if x else None
        if not own:
            out.add(("t", k, period, "missing"))
        elif x:
            born, gone = min(p[1] for p in own), min([p[2] for p in own if p[2]], default=None)
            if gone and gone <= x:
                out.add(("t", k, period, "deleted"))
            elif born > x:
                out.add(("t", k, period, "late"))
    return sorted(out, key=lambda r: tuple(str(c) for c in r))


def test_kinds_against_brute_force(spark):
    refs = [("a", "2025-03-05"), ("a", "2025-04-05"), ("b", "2025-03-01"), ("b", "2025-03-20"), ("c", "2025-03-31"), ("d", "2025-05-01"), (None, "2025-01-01"), ("e", "2025-03-03"), ("e", "2025-03-03"), ("f", "2025-06-10"), ("f", "2025-06-20")]
    parents = [("a", "2025-01-01", None), ("a", "2025-02-01", None), ("b", "2025-03-10", None), ("c", "2025-01-01", "2025-03-31"), ("e", "2025-03-04", "2025-03-03"), ("f", "2025-06-15", "2025-06-18")]
    assert run(spark, refs, parents) == brute(refs, parents)
    assert ("t", "f", "2025-06", "deleted") in run(spark, refs, parents) and ("t", "f", "2025-06", "late") in run(spark, refs, parents)


def test_empty_null_time_and_no_parents(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [("a", "2025-01-01", None)]) == []
    assert run(spark, [("a", "2025-01-02"), ("b", None)], []) == [("t", "a", "2025-01", "missing"), ("t", "b", None, "missing")]
    assert run(spark, [("a", None)], [("a", "2025-01-01", None)]) == []


def test_one_key_with_most_rows_and_codes_are_dense(spark):
    refs = [("hot", f"2025-0{m}-15") for m in range(1, 10) for _ in range(200)] + [(f"k{i}", "2025-02-02") for i in range(300)]
    parents = [("hot", "2025-03-01", None)] + [(f"k{i}", "2024-01-01", None) for i in range(0, 300, 2)]
    assert run(spark, refs, parents) == brute(refs, parents)
    keys = spark.createDataFrame([("t", f"k{i}") for i in range(1000)], "relation string, ref_key string")
    codes = encode_keys(keys, 100).collect()
    assert len({(r.container, r.bit) for r in codes}) == 1000 and len({r.container for r in codes}) == 10
