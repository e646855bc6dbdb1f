"""What the corpus operators share: reading tables, stored steps, ordered buckets."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_location

# Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; ``TOKENIZER_DIR`` overrides it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


_remembered: dict = {}


def remembered(key, make: Callable):
    """What a Python worker keeps from task to task, made at its first use.

    One thing at a time: workers outlive operators, and what several of them remember
    would add up.
    """
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make()
    return _remembered[key]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read back, and its path.

    It cuts the lineage, and an executor that is lost takes nothing with it.
    """
    spark = df.sparkSession
    path = new_location(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends: steps read stored tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def unused(df: DataFrame, name: str, *others: str) -> str:
    """A column name like ``name`` that ``df`` and ``others`` do not have."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case, as UTF-8.

    Methods of ``bytes`` know ASCII letters and ASCII white space only, which is what
    is asked for here.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def lower_ascii_column(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def ordered_bucket(df: DataFrame, key: str, buckets: int) -> Column:
    """A bucket number that does not fall as a numeric ``key`` rises; nulls come first.

    The bounds are approximate quantiles over all rows, so buckets are about equal
    and the same whenever a row is read again.
    """
    if buckets < 2:
        return F.lit(0)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.stat.approxQuantile(key, shares, 1 / (4 * buckets))))
    if not bounds:
        return F.lit(0)
    at = F.col(key).cast("double")
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= at))
    return F.when(F.col(key).isNull(), 0).otherwise(below).cast("int")
