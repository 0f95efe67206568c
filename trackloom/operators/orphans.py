"""References to records that do not exist.

Keys are dictionary-encoded as integers: a key falls into one of `ranges` hash ranges and gets its rank
inside the range, so codes are dense and a range's codes are cut into containers of 32,768 bits. Per
container and period there is one bitmap of the keys referred to and one of the keys whose record lives
through the whole period. References AND-NOT living leaves the suspicious keys; their bits are decoded
through the dictionary and only they are checked against exact times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.session import written

BITS = 32768  # bits of a container, fixed by Spark's bitmap functions


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _bits_left(refs: pd.Series, parents: pd.Series) -> pd.Series:
    """Set bits of refs AND NOT parents; a missing parent bitmap is empty."""

    def one(r: bytes, p: bytes | None) -> np.ndarray:
        left = np.frombuffer(r, np.uint8)
        if p is not None:
            left = left & ~np.frombuffer(p, np.uint8)
        return np.flatnonzero(np.unpackbits(left, bitorder="little")).astype(np.int32)

    return pd.Series([one(r, p) for r, p in zip(refs, parents)], dtype=object)


def encode_keys(keys: DataFrame, keys_per_range: int = 16384) -> DataFrame:
    """(relation, ref_key) -> (relation, ref_key, container, bit); keys must be distinct.
    The number of ranges follows the number of keys, so a range stays small however many keys there are."""
    ranges = max(1, -(-keys.count() // keys_per_range))
    spot = Window.partitionBy("relation", "key_range").orderBy("ref_key")
    return (
        keys.withColumn("key_range", F.pmod(F.xxhash64("ref_key"), F.lit(ranges)))
        .withColumn("code", F.row_number().over(spot) - 1)
        .select(
            "relation",
            "ref_key",
            F.concat_ws("/", "key_range", F.floor(F.col("code") / BITS).cast("string")).alias("container"),
            (F.col("code") % BITS).cast("int").alias("bit"),
        )
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Report references whose record is missing, deleted or late.

    refs: relation, ref_key, loaded_at, one row per referring row. parents: relation, ref_key, loaded_at,
    deleted_at, one row per delivered record. Other columns are ignored. Result: table_name (the relation),
    ref_key, period (YYYY-MM of the referring loaded_at), kind; one row per distinct combination.

    Null keys are no references. A key delivered twice counts from its earliest loaded_at and, if any
    delivery is withdrawn, to its earliest deleted_at. A reference with null loaded_at has period null and
    can only be `missing`. Empty tables give an empty result; without parents every reference is missing.
    Keys that hold most of the rows are reduced by map-side combine to one row per key and period.
    """
    used = written(
        refs.where(F.col("ref_key").isNotNull())
        .groupBy("relation", "ref_key", F.date_format("loaded_at", "yyyy-MM").alias("period"))
        .agg(F.min("loaded_at").alias("first_use"), F.max("loaded_at").alias("last_use"))
        .withColumn("slot", F.coalesce("period", F.lit("")))
    )
    known = written(
        parents.where(F.col("ref_key").isNotNull())
        .groupBy("relation", "ref_key")
        .agg(F.min("loaded_at").alias("born"), F.min("deleted_at").alias("gone"))
    )
    keys = used.select("relation", "ref_key").union(known.select("relation", "ref_key")).distinct()
    codes = written(encode_keys(written(keys)))

    # keys, codes and bitmaps grow with the data: they meet by merge joins, none is broadcast
    codes = codes.hint("merge")
    coded = used.join(codes, ["relation", "ref_key"])
    wanted = coded.groupBy("relation", "container", "slot").agg(F.bitmap_construct_agg("bit").alias("refs"))
    own = known.join(codes, ["relation", "ref_key"])
    # periods that a record lives through from end to end, clipped to those that occur in the references
    span = used.where(F.col("period").isNotNull()).agg(
        F.to_date(F.concat(F.min("period"), F.lit("-01"))).alias("from_month"),
        F.to_date(F.concat(F.max("period"), F.lit("-01"))).alias("to_month"),
    )
    first = span.first()
    if first["from_month"] is None:
        living = wanted.where(F.lit(False)).withColumnRenamed("refs", "living")
    else:
        starts = F.greatest(F.lit(first["from_month"]), F.add_months(F.trunc("born", "month"), 1))
        ends = F.least(F.lit(first["to_month"]), F.coalesce(F.add_months(F.trunc("gone", "month"), -1), F.lit(first["to_month"])))
        living = (
            own.where(F.col("born").isNotNull() & (starts <= ends))
            .withColumn("month", F.explode(F.sequence(starts, ends, F.expr("interval 1 month"))))
            .groupBy("relation", "container", F.date_format("month", "yyyy-MM").alias("slot"))
            .agg(F.bitmap_construct_agg("bit").alias("living"))
        )
    survivors = (
        wanted.join(living.hint("merge"), ["relation", "container", "slot"], "left")
        .select("relation", "container", "slot", F.explode(_bits_left("refs", "living")).alias("bit"))
    )
    suspects = (
        survivors.join(codes, ["relation", "container", "bit"])
        .join(used.hint("merge"), ["relation", "ref_key", "slot"])
        .join(known.withColumn("there", F.lit(True)).hint("merge"), ["relation", "ref_key"], "left")
    )
    kinds = F.when(F.col("there").isNull(), F.array(F.lit("missing"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("gone") <= F.col("last_use"), F.lit("deleted")),
                F.when(
                    (F.col("first_use") < F.col("born"))
                    & (F.col("gone").isNull() | (F.col("first_use") < F.col("gone"))),
                    F.lit("late"),
                ),
            )
        )
    )
    return suspects.select(F.col("relation").alias("table_name"), "ref_key", "period", F.explode(kinds).alias("kind"))
