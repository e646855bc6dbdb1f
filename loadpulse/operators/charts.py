"""Series prepared for charting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stores


def series_ordered(series: DataFrame) -> DataFrame:
    """Series rows in time order, job by job."""
    return series.orderBy("job_id", "timestamp", "query_action")


def chart_series(series: DataFrame, by: list[str], seed: object | None = None) -> DataFrame:
    """Points (line, x, y) of the three charts of every series.

    ``by`` names the columns that tell series apart.  Rows count only if their
    seed is the asked one; with no seed asked, only rows that have none.  ``x`` is
    seconds from the first such row.  Latencies are in milliseconds for both
    actions, and every row is also a point of the failure line.
    """
    wanted = series
    if "seed" in series.columns:
        asked = F.lit(None if seed is None else str(seed)).cast("string")
        wanted = series.where(F.col("seed").cast("string").eqNullSafe(asked))
    start = wanted.groupBy(*by).agg(F.min("timestamp").alias("start"))
    points = F.explode(F.array(
        F.struct(
            F.when(F.col("query_action") == "read", "read_latency")
             .otherwise("write_latency").alias("line"),
            (F.col("average_latency") * 1000).alias("y"),
        ),
        F.struct(F.lit("failure_percent").alias("line"),
                 F.col("failure_percent").cast("double").alias("y")),
    ))
    return (
        wanted.join(stores.stored(start, "starts"), by)
        .select(*by, ((F.col("timestamp") - F.col("start")) / 1000).alias("x"), points.alias("p"))
        .select(*by, "p.line", "x", "p.y")
    )
