"""Column contracts and missing-value rules used across the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its declared contract."""


def require_columns(df: DataFrame, names: Iterable[str], table: str = "table") -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ContractError(f"{table} lacks the columns {absent}")
    return df


def require_unique(df: DataFrame, keys: Sequence[str], table: str = "table") -> DataFrame:
    """Raise if a key occurs twice; one aggregate with map-side combine, five examples at most."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if repeated:
        raise ContractError(f"{table} repeats the key {list(keys)}: {repeated}")
    return df


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """An equi-join that first checks the side(s) declared unique in validate ('1:1', 'm:1', '1:m')."""
    if validate.startswith("1"):
        require_unique(left, on, "left side")
    if validate.endswith("1"):
        require_unique(right, on, "right side")
    return left.join(right, list(on), how)


def present(c: Column | str) -> Column:
    """NaN means missing: NaN becomes NULL, everything else stays."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({n: present(n) for n, kind in df.dtypes if kind in ("double", "float")})
