"""Partitioned tables for series, caches and resources, and the job list file.

Series live under ``job_id=...``; a cache under ``key=.../pattern=...``;
resources under ``database_type=.../database_size=...``.  A filter on those
columns prunes folders before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import new_location

SERIES_PARTITIONS = ["job_id"]
CACHE_PARTITIONS = ["key", "pattern"]
LIVE_CACHE_PARTITIONS = ["key", "pattern", "seed"]
RESOURCE_PARTITIONS = ["database_type", "database_size"]

CACHE = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("pattern", T.StringType())]
    + schemas.SERIES.fields
    + [T.StructField("seed", T.StringType())]
)


def append_partitioned(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Append ``df`` under its partition folders.

    Rebalancing on the partition columns keeps one folder's rows in few files;
    the adaptive planner splits a folder that holds most of the rows.
    """
    (df.hint("rebalance", *partitions)
       .write.mode("append").partitionBy(*partitions).parquet(path))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its size is known to the planner, and a
    join with it is one of plain tables, which adaptive execution can split."""
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the table's place, for those who delete it after use."""
    path = new_location(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def read_series(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """All window results below ``path``, or those of one job."""
    series = spark.read.schema(schemas.SERIES).parquet(path)
    return series if job_id is None else series.where(F.col("job_id") == job_id)


def read_cached_series(
    spark: SparkSession, path: str, key: str | None = None, pattern: str | None = None
) -> DataFrame:
    """The rows of a cache, or those of one location in it."""
    cached = spark.read.schema(CACHE).parquet(path)
    if key is not None:
        cached = cached.where(F.col("key") == key)
    if pattern is not None:
        cached = cached.where(F.col("pattern") == pattern)
    return cached


def copy_series(
    spark: SparkSession,
    source: str,
    target: str,
    partitions: list[str],
    where: Column | None = None,
    seed: object | None = None,
) -> None:
    """Append the rows of one stored table to another, optionally tagged with a seed."""
    rows = spark.read.parquet(source)
    if where is not None:
        rows = rows.where(where)
    if seed is not None:
        rows = rows.withColumn("seed", F.lit(str(seed)))
    append_partitioned(rows, target, partitions)


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """Every resource of every (type, size) pool; the pool comes from the folders."""
    return spark.read.schema(schemas.RESOURCE).parquet(path)


def read_job_list(spark: SparkSession, path: str) -> DataFrame:
    """Job ids of a text file, one per line, with ``seq`` ordered as the lines are.

    Splits of a file are read independently, so a line's place is its split's
    offset and then its turn within the task that read it.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("job_id"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
    )
    return lines.where(F.col("job_id") != "")
