"""Transaction messages, bounded and unbounded.

Every reader gives the columns of ``schemas.MESSAGE``, so the jobs downstream
are the same functions for files and for streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

_FIELDS = schemas.TRANSACTION.fieldNames()


def _as_messages(rows: DataFrame, fmt: str) -> DataFrame:
    # A topic's own timestamp is the time the message was published.
    if fmt == "kafka":
        return rows.select(F.col("timestamp").alias("publish_time"),
                           F.col("value").cast("string").alias("data"))
    return rows.select(F.col("publish_time").cast("timestamp").alias("publish_time"), "data")


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Bounded messages with explicit publish times."""
    reader = spark.read.format(fmt).options(**options)
    if fmt != "kafka":
        reader = reader.schema(schemas.MESSAGE)
    return _as_messages(reader.load(path) if path else reader.load(), fmt)


# What a micro-batch of a file stream takes at most, unless its options say otherwise.
FILES_PER_BATCH = 512


def stream_messages(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet", **options
) -> DataFrame:
    """Unbounded messages: ``fmt="kafka"`` with its options, or files arriving in ``path``."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt != "kafka":
        reader = reader.schema(schemas.MESSAGE)
        if "maxFilesPerTrigger" not in options:
            reader = reader.option("maxFilesPerTrigger", FILES_PER_BATCH)
    return _as_messages(reader.load(path) if path else reader.load(), fmt)


def messages_from_records(records: DataFrame) -> DataFrame:
    """Each record as a message of its own (a JSON array of one), without a shuffle."""
    return records.select(
        "publish_time",
        F.to_json(F.array(F.struct(*_FIELDS))).alias("data"),
    )
