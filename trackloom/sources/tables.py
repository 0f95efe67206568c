"""Table scans: Parquet by name with projection and conjunctive filters, CSV/TSV/JSON text sources."""

from __future__ import annotations

import re
from collections.abc import Sequence
from operator import eq, ge, gt, le, lt, ne

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPARE = {"=": eq, "==": eq, "!=": ne, ">": gt, ">=": ge, "<": lt, "<=": le}


# Fixed: the second naming scheme of the delivered tables.
NAMINGS = {
    "frame_table": {f"site{s}_{c}": f"site_{side}_{c}" for s, side in ((1, "left"), (2, "right")) for c in ("x_nm", "y_nm", "valid")},
    "bundle_metadata": {f"site{s}_valid_count": f"{side}_valid_count" for s, side in ((1, "left"), (2, "right"))},
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet file or directory `name` of the folder, as delivered."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_naming(df: DataFrame, name: str) -> DataFrame:
    """site1/site2 columns filled from left/right where they are null; a row of both schemes keeps site1/site2."""
    return df.withColumns({a: F.coalesce(a, b) for a, b in NAMINGS.get(name, {}).items()})


def named_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` with all rows under the site1/site2 names, whichever scheme they came under."""
    return one_naming(table(spark, folder, name), name)


def named_sql(sql: str) -> str:
    """The same for a DuckDB query: it reads its tables through views of one naming."""
    used = [t for t in NAMINGS if re.search(rf"\b{t}\b", sql)]
    if not used:
        return sql
    views = ", ".join(f"{t}_named as (select * replace ({', '.join(f'coalesce({a}, {b}) as {a}' for a, b in NAMINGS[t].items())}) from {t})" for t in used)
    own = re.sub(rf"\b({'|'.join(used)})\b", r"\1_named", sql).lstrip()
    return f"with {views}, {own[5:]}" if own.startswith("with ") else f"with {views} {own}"


def load_table(
    spark: SparkSession,
    registry: dict[str, str],
    name: str,
    columns: Sequence[str] | None = None,
    filters: Sequence[tuple[str, str, object]] = (),
) -> DataFrame:
    """A registered Parquet table with projection and AND-ed filters; both reach the scan.
    KeyError for an unknown table, ValueError for an unknown comparison."""
    if name not in registry:
        raise KeyError(f"no table {name!r} is registered")
    df = spark.read.parquet(registry[name])
    for column, op, value in filters:
        if op not in COMPARE:
            raise ValueError(f"unknown comparison {op!r}")
        df = df.where(COMPARE[op](F.col(column), F.lit(value)))
    return df.select(*columns) if columns else df
