"""Latency and failure rate per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import timing


def windowed_latency_failure(
    records: DataFrame, width: str = K.RESULT_WINDOW, when_all_failed: str = "nan"
) -> DataFrame:
    """The series: average latency and failure percentage per window, operation and job.

    Latency is averaged over successes only.  A window with failures only has a
    NaN average (``when_all_failed="null"`` gives null).  The function is the
    same for a batch and for a stream with a watermark.
    """
    ok = F.col("success")
    return (
        records.groupBy(F.window("publish_time", width).alias("w"), "operation", "job_id")
        .agg(
            F.sum(F.when(ok, timing.latency())).alias("latency_sum"),
            F.count(F.when(ok, 1)).alias("successes"),
            F.count("*").alias("total"),
        )
        .select(
            "job_id",
            F.col("operation").alias("query_action"),
            timing.quotient_or_nan(F.col("latency_sum"), F.col("successes"), when_all_failed)
                  .alias("average_latency"),
            timing.failure_percent(F.col("total") - F.col("successes"), F.col("total"))
                  .alias("failure_percent"),
            timing.window_timestamp(F.col("w")).alias("timestamp"),
        )
    )


def sql_windowed_latency(records: DataFrame, width: str = K.PROTOTYPE_WINDOW) -> DataFrame:
    """The SQL prototype's result per window and action.

    Averages connection time over all rows, and gives failures as a fraction of
    one under the name ``failure_percent``.
    """
    window = F.window("publish_time", width).alias("w")
    return (
        records.groupBy(window, F.col("transaction_type").alias("query_action"))
        .agg(F.avg(timing.prototype_latency()).alias("latency"),
             F.avg(timing.failure_flag(F.col("success"))).alias("failed"))
        .select(F.col("latency").cast("float").alias("average_latency"),
                F.col("failed").cast("float").alias("failure_percent"),
                "query_action", timing.window_timestamp(F.col("w")).alias("timestamp"))
    )


def run_throughput(records: DataFrame) -> DataFrame:
    """Transactions per second of each job between its first start and last end."""
    return (
        records.groupBy("job_id")
        .agg(
            F.count("*").alias("transactions"),
            (F.max("transaction_end") - F.min("transaction_start")).alias("elapsed"),
        )
        .withColumn("per_second", F.try_divide("transactions", "elapsed"))
    )
