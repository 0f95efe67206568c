"""Sinks: Parquet, partitioned by acquisition, published at once with a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _filesystem(df: DataFrame, path: str):
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def content_digest(df: DataFrame) -> dict[str, object]:
    """Rows and an order-independent digest of the content: the sums of two 32-bit slices of every row's SHA-256."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    r = df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("a"), part(9).alias("b")).first()
    return {"rows": r["rows"], "digest": f"{r['a']}-{r['b']}", "columns": dict(df.dtypes)}


def publish(tables: dict[str, DataFrame], target: str, partition_by: dict[str, list[str]] | None = None) -> dict:
    """Write tables as zstd Parquet under a staging folder beside `target` and rename it there, with manifest.json.
    An existing target is refused; a failure leaves no target and no staging folder."""
    any_df = next(iter(tables.values()))
    fs, final = _filesystem(any_df, target)
    if fs.exists(final):
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    _, stage = _filesystem(any_df, staging)
    manifest = {}
    try:
        for name, df in tables.items():
            writer = df.write.mode("errorifexists").option("compression", "zstd")
            by = (partition_by or {}).get(name)
            (writer.partitionBy(*by) if by else writer).parquet(f"{staging}/{name}.parquet")
            manifest[name] = content_digest(df.sparkSession.read.parquet(f"{staging}/{name}.parquet").select(*df.columns))
        out = fs.create(any_df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{staging}/manifest.json"))
        out.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
        out.close()
        if not fs.rename(stage, final):
            raise OSError(f"cannot rename to {target}")
    except BaseException:
        fs.delete(stage, True)
        raise
    return manifest


def verify(spark_df: DataFrame, expected: dict) -> bool:
    """Whether a table still has the rows and digest of its manifest entry."""
    got = content_digest(spark_df)
    return got["rows"] == expected["rows"] and got["digest"] == expected["digest"]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
