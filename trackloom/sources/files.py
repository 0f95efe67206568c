"""Text sources: trajectory CSV, TSV, hour maps, acquisition metadata with its exact time vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.contracts import ContractError
from trackloom.functions.numeric import flag

POINT = "frame long, x_nm double, y_nm double"
#: Channel code of a trajectory file -> site; fixed values.
CHANNELS = {"R": "site1", "P": "site2", "G": "53bp1_spt"}


def read_trajectories(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """frame, x_nm, y_nm and the source file of trajectory CSVs. A value that is no number is an error; a file
    without rows gives none. Files with more columns are read by name."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("enforceSchema", False).schema(POINT).csv(path)
    return df.withColumn("file", F.input_file_name())


def with_identity(points: DataFrame) -> DataFrame:
    """channel, allele_index and site from file names like <name>_<channel>_a<number>.csv; other files are left out."""
    name = F.element_at(F.split("file", "/"), -1)
    out = points.withColumns({"channel": F.regexp_extract(name, r"_([RPG])_a(\d+)\.csv$", 1), "allele_index": F.regexp_extract(name, r"_([RPG])_a(\d+)\.csv$", 2)})
    site = F.coalesce(*[F.when(F.col("channel") == c, s) for c, s in CHANNELS.items()])
    return out.where("channel <> ''").withColumns({"site_id": site, "allele_index": F.col("allele_index").cast("long")})


def bundle_id(nd2: str = "nd2_id", crop: str = "crop_id", allele: str = "allele_index"):
    """nd2|crop|aNNN."""
    return F.format_string("%s|%s|a%03d", F.col(nd2), F.col(crop), F.col(allele).cast("long"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text with a header, typed; an empty file gives no rows."""
    return spark.read.option("header", True).option("sep", "\t").schema(schema).csv(path)


def usable_cells(index: DataFrame) -> DataFrame:
    """Rows of a cell index whose artifacts are marked usable."""
    return index.where(flag(F.col("trajectory_artifacts_usable")))


def hour_map(rows: DataFrame) -> DataFrame:
    """(nd2_id, fov_id, hour, source): ids without suffix and blanks; hours with an `inferred:` source are null. An
    id with two different hours is an error; of repeated rows the first by source counts."""
    ids = F.regexp_replace(F.trim("nd2_id"), r"\.nd2$", "")
    clean = rows.select(ids.alias("nd2_id"), "fov_id", F.when(~F.startswith("source", F.lit("inferred:")) | F.col("source").isNull(), F.col("hour")).alias("hour"), "source")
    bad = clean.groupBy("nd2_id").agg(F.count_distinct("hour").alias("n")).where("n > 1").limit(5).collect()
    if bad:
        raise ContractError(f"conflicting hours: {[r.nd2_id for r in bad]}")
    return clean.withColumn("k", F.row_number().over(Window.partitionBy("nd2_id").orderBy(F.col("hour").isNull(), "source"))).where("k = 1").drop("k")


TIMES = "nd2_id string, n_frames long, finterval_s double, time struct<relative_time_s: array<double>>"


def exact_times(spark: SparkSession, path: str) -> DataFrame:
    """(nd2_id, frame, time_s) from metadata JSON documents: the exact vector, else frames times the interval. A
    vector that does not increase strictly is an error."""
    doc = spark.read.option("multiLine", True).schema(TIMES).json(path)
    even = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1), lambda i: i * F.col("finterval_s"))
    vector = F.coalesce("time.relative_time_s", F.when((F.col("n_frames") > 0) & (F.col("finterval_s") > 0), even))
    back = F.exists(F.sequence(F.lit(2), F.size(vector)), lambda i: F.element_at(vector, i) <= F.element_at(vector, i - 1))
    bad = doc.where((F.size(vector) > 1) & back).select("nd2_id").limit(5).collect()
    if bad:
        raise ContractError(f"times do not increase: {[r.nd2_id for r in bad]}")
    return doc.select("nd2_id", F.posexplode(vector).alias("frame", "time_s")).withColumn("frame", F.col("frame") + 1)
