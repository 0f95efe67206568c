from collections import defaultdict

import numpy as np
import pytest

from trackloom.llm.packing import Levels, pack

SCHEMA = "doc_id long, n_tokens long, box string, into string"


def brute_choice(count, size, capacity):
    """Level whose choice leaves the least sum of squares over partly filled levels; of equals the fullest."""

    def cost(level):
        c = count.copy()
        if level:
            c[level] -= 1
        if level + size < capacity:
            c[level + size] += 1
        return (c[1:capacity] ** 2).sum()

    able = [h for h in range(capacity - size + 1) if h == 0 or count[h] > 0]
    return min(able, key=lambda h: (cost(h), -h))


def test_each_choice_is_the_sum_of_squares_rule():
    rng = np.random.default_rng(4)
    for capacity in (1, 2, 7, 30):
        levels = Levels(capacity)
        for size in rng.integers(1, capacity + 1, 300).tolist():
            want = brute_choice(levels.count, size, capacity)
            box = levels.place(size)
            assert levels.fill[box] == want + size <= capacity


def run(spark, rows, capacities):
    return pack(spark.createDataFrame([(d, n, "", "") for d, n in rows], SCHEMA).repartition(3), capacities).collect()


def test_every_token_has_one_place_and_none_is_over_full(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.lognormal(5, 1.2, 600))] + [(1000, 0), (1001, None), (1002, 64), (1003, 640), (1004, 641)]
    got = run(spark, rows, [(1, 64), (2, 1000)])
    for p, capacity in ((1, 64), (2, 1000)):
        own = [r for r in got if r.pack_id == p]
        fill, per = defaultdict(int), defaultdict(list)
        for r in own:
            if r.container_id is not None:
                fill[r.container_id] += r.n_tokens
            per[r.doc_id].append((r.first_token, r.n_tokens))
        assert max(fill.values()) <= capacity and min(fill.values()) > 0
        for d, n in rows:
            pieces = sorted(per[d])
            assert pieces == [(i * capacity, min(capacity, (n or 0) - i * capacity)) for i in range(max(1, -(-(n or 0) // capacity)))]
        total = sum(n or 0 for _, n in rows)
        assert len(fill) <= 1.1 * total / capacity + 2
    assert {r.container_id for r in got if r.doc_id in (1000, 1001)} == {None}


def test_empty_repeated_and_bad_capacity(spark):
    assert run(spark, [], [(1, 8)]) == []
    same = run(spark, [(1, 5)] * 4 + [(None, 3)], [(1, 8)])
    assert len(same) == 5 and sum(r.n_tokens for r in same) == 23
    with pytest.raises(ValueError):
        run(spark, [(1, 5)], [(1, 0)])
