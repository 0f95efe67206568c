"""Filling containers of fixed capacity: sum-of-squares online packing.

Every item goes to the fill level at which the sum, over levels, of the squared number of partly filled
containers grows least (a container that becomes full leaves the sum). The levels are an array of counts,
so placing an item is one scan over it. Each task packs its own items. The items of containers less than KEEP
full are packed again, largest first and mixed with those of other tasks, and what is loose then once more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.session import written

ITEMS_A_TASK = 50_000  # items that one task packs again
KEEP = 0.95
ROUNDS = ("a", "b")  # names of the rounds after the first, in the containers' ids


class Levels:
    """Level array of one capacity: how many open containers have each fill, and which."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.fill: list[int] = []

    def place(self, size: int) -> int:
        """Number of the container that takes an item of 1..capacity; a new one if that is best."""
        c, top = self.count, self.capacity - size
        # change of the sum of squares when a container at level h moves to h + size
        gain = 2 * (c[size : self.capacity + 1] - c[: top + 1]) + 2
        gain[top] = 1 - 2 * c[top]  # it becomes full
        gain[0] = 2 * c[size] + 1 if top else 0  # a new container
        able = c[: top + 1] > 0
        able[0] = True
        gain[~able] = np.iinfo(np.int64).max
        level = top - int(gain[::-1].argmin())  # of equals the fullest
        if level:
            box = self.open[level].pop()
            c[level] -= 1
        else:
            box = len(self.fill)
            self.fill.append(0)
        self.fill[box] = level + size
        if level + size < self.capacity:
            c[level + size] += 1
            self.open.setdefault(level + size, []).append(box)
        return box


PLACED = "pack_id long, capacity long, box string, fill long, doc_id long, piece int, n_tokens long"
COLUMNS = [c.split()[0] for c in PLACED.split(", ")]


class _Packed:
    """Items of one task and pack, with the container each went to; handed out when the final fills are known."""

    def __init__(self, capacity: int) -> None:
        self.levels = Levels(capacity)
        self.box: list[int] = []
        self.doc: list[int] = []
        self.piece: list[int] = []
        self.size: list[int] = []

    def put(self, docs: list[int], pieces: list[int], sizes: list[int]) -> None:
        self.box += [self.levels.place(n) for n in sizes]
        self.doc += docs
        self.piece += pieces
        self.size += sizes

    def frame(self, pack_id: int, prefix: str) -> pd.DataFrame:
        fill = np.array(self.levels.fill, np.int64)[np.array(self.box, np.int64)]
        names = pd.Series([f"{prefix}{b}" for b in self.box], dtype=object)
        return _rows(pack_id, self.levels.capacity, names, fill, self.doc, self.piece, self.size)


def _rows(pack_id: int, capacity: int, box, fill, doc, piece, size) -> pd.DataFrame:
    return pd.DataFrame({"pack_id": pack_id, "capacity": capacity, "box": box, "fill": fill, "doc_id": pd.Series(doc, dtype="Int64"), "piece": piece, "n_tokens": size})[COLUMNS]


def pack(sizes: DataFrame, capacities: Sequence[tuple[int, int]]) -> DataFrame:
    """(pack_id, container_id, doc_id, piece, first_token, n_tokens): a container for every piece.

    sizes: doc_id (long), n_tokens; capacities: (pack_id, capacity). A document over the capacity is cut into
    full pieces and a rest; any other is one piece. Documents of no tokens, null sizes included, take no
    room: one row with null container. Capacities under 1 are an error. Ties and repeated rows are packed
    one by one; an empty table gives an empty result. A task places the items of a batch largest first and holds
    the numbers, not the texts, of its items.
    """
    if any(not c or c < 1 for _, c in capacities):
        raise ValueError("capacities must be at least 1")
    wanted = [(int(p), int(c)) for p, c in capacities]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packed = {p: _Packed(c) for p, c in wanted}
        full = 0
        for pdf in batches:
            ids, sizes = pdf["doc_id"].astype("Int64").to_numpy(object, na_value=None), pdf["n_tokens"].fillna(0).to_numpy(np.int64)
            none = np.flatnonzero(sizes == 0)
            for p, c in wanted:
                if len(none):
                    yield _rows(p, c, pd.Series([None] * len(none), dtype=object), pd.Series([None] * len(none), dtype="Int64"), ids[none], 0, 0)
                pieces, rest = np.divmod(sizes, c)
                whole = np.repeat(np.arange(len(ids)), pieces)
                if len(whole):
                    part = np.arange(len(whole)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    yield _rows(p, c, pd.Series([f"{task}/f{full + i}" for i in range(len(whole))], dtype=object), c, ids[whole], part, c)
                    full += len(whole)
                at = np.flatnonzero(rest)
                at = at[np.argsort(-rest[at], kind="stable")]
                packed[p].put(ids[at].tolist(), pieces[at].tolist(), rest[at].tolist())
        for p, own in packed.items():
            if own.box:
                yield own.frame(p, f"{task}/")

    def again(batches: Iterator[pd.DataFrame], mark: str) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, packed = TaskContext.get().partitionId(), {}
        for pdf in batches:
            for (p, c), own in pdf.groupby(["pack_id", "capacity"], sort=False):
                packed.setdefault(p, _Packed(c)).put(own["doc_id"].astype("Int64").to_numpy(object, na_value=None).tolist(), own["piece"].tolist(), own["n_tokens"].tolist())
        for p, own in packed.items():
            yield own.frame(p, f"{mark}{task}/")

    done = []
    placed = written(sizes.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long")).mapInPandas(first, PLACED))
    loose = F.col("fill") < KEEP * F.col("capacity")
    for mark in ROUNDS:
        done.append(placed.where(~F.coalesce(loose, F.lit(False))))
        left = placed.where(loose)
        groups = max(1, -(-left.count() // ITEMS_A_TASK))
        mixed = left.repartition(groups, F.xxhash64("pack_id", "doc_id", "piece", "box")).sortWithinPartitions("pack_id", F.desc("n_tokens"), "doc_id", "piece", "box")
        placed = written(mixed.mapInPandas(partial(again, mark=mark), PLACED))
    return reduce(DataFrame.unionByName, [*done, placed]).select(
        "pack_id", F.col("box").alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), "n_tokens"
    )
