"""Gap-free ids over a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_location
from ..sources import ledger, snapshots

_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row's place


def with_dense_ids(
    df: DataFrame, order_by: list[str], id_column: str = "id", first: int | Column = 1,
    keep: list[str] | None = None,
) -> DataFrame:
    """Number the rows ``first, first + 1, ...`` in the order of ``order_by``.

    ``keep`` names the columns to carry along (all by default).

    The rows are range-partitioned by the whole ordering, so a value that
    repeats is spread as long as the ordering tells its rows apart.  Each row's
    id is the size of the ranges before it plus its place in its own range.
    The ranged rows are written to the shared folder first: counts and places
    then describe the same rows even when a task has to run again.
    """
    spark = df.sparkSession
    path = new_location(spark, "ranged")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    (df.repartitionByRange(*order_by)
       .sortWithinPartitions(*order_by)
       .select(*(keep or df.columns), F.spark_partition_id().alias("_range"), place.alias("_place"))
       .write.parquet(path))
    ranged = spark.read.parquet(path)

    # One row per range, at most as many as there are shuffle partitions: this is
    # the bound for the unpartitioned window and for the broadcast.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    base = first if isinstance(first, Column) else F.lit(first)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(id_column, (base + F.col("_offset") + F.col("_place")).cast("bigint"))
        .drop("_range", "_place", "_offset")
    )


def append_with_ids(
    rows: DataFrame, path: str, writer: str, update: int = 0, id_column: str = "id",
) -> tuple[int, int]:
    """Append ``rows`` to the table at ``path`` under ids that go on where its last end;
    the first id and their number.

    Nothing is sorted or shuffled, and the table is not read: the rows are stored as
    they come, counted per part, and a range of ids is reserved in the table's ledger.
    A row's id is the range's first, plus the rows of the parts before, plus its place
    in its part; ids therefore say nothing about an order.  An update that runs again
    gets the same range and replaces its own folder, so it changes nothing but which of
    its rows has which of its ids.  No rows reserve nothing.
    """
    spark = rows.sparkSession
    own = [c for c in rows.columns if c != id_column]
    for name in ("_part", "_place", BATCH):
        if name in own:
            raise ValueError(f"a column of the table may not be called {name}")
    kept = new_location(spark, "appended")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    rows.select(*own, F.spark_partition_id().alias("_part"), place.alias("_place")).write.parquet(kept)
    placed = spark.read.schema(T.StructType([
        *rows.select(*own).schema.fields,
        T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType()),
    ])).parquet(kept)
    # A row per task that wrote: the bound of the window and of the broadcast.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    total = placed.count()
    first = ledger.next_id(spark, _ledger(path))
    if total:
        first = ledger.reserve(spark, _ledger(path), total, writer, update)
        (placed.join(F.broadcast(offsets), "_part")
         .select((F.lit(first) + F.col("_offset") + F.col("_place")).cast("bigint").alias(id_column), *own)
         .write.mode("overwrite").parquet(f"{path}/{BATCH}={first}"))
    snapshots.delete(spark, kept)
    return first, total


BATCH = "first_id"  # the folders of a table with a ledger: the first id of each append


def _ledger(path: str) -> str:
    return f"{path}/_ids"


def read_with_ids(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that ``append_with_ids`` fills, with the first id of each row's append: a
    filter on that reads only its folder."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(path)
