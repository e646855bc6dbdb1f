"""Columns for latency, failures, window timestamps and composed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latency() -> Column:
    """Seconds between start and end of the transaction."""
    return F.col("transaction_end") - F.col("transaction_start")


def prototype_latency() -> Column:
    """Connection time as the SQL prototype takes it: single precision."""
    return F.col("connection_end").cast("float") - F.col("connection_start").cast("float")


def failure_flag(success: Column) -> Column:
    """1 for a failure; an unknown outcome is a failure too."""
    return F.when(success, 0).otherwise(1)


def quotient_or_nan(total: Column, count: Column, when_empty: str = "nan") -> Column:
    """``total / count``, with NaN (or null) where there is nothing to average."""
    empty = F.lit(float("nan")) if when_empty == "nan" else F.lit(None).cast("double")
    return F.when(count == 0, empty).otherwise(total / count)


def failure_percent(failures: Column, total: Column) -> Column:
    """Failures per hundred in single precision at every step (1 of 3 is 33.333336)."""
    share = (failures.cast("float") / total.cast("float")).cast("float")
    return (share * F.lit(100).cast("float")).cast("float")


def window_timestamp(window: Column) -> Column:
    """Epoch milliseconds of the last instant inside a window."""
    return F.unix_millis(window["end"].cast("timestamp")) - 1


def split_key(key: Column) -> Column:
    """Struct (query_action, job_id) of a composed ``action-job`` key.

    The first dash separates, so job ids may contain dashes and actions may not.
    """
    dash = F.instr(key, "-")
    return F.struct(
        F.substring_index(key, "-", 1).alias("query_action"),
        F.substr(key, dash + 1).alias("job_id"),
    )


def with_timing_fallback(records: DataFrame) -> DataFrame:
    """Fill the times a database did not report.

    A transaction that never began takes its connection's end for both times, so
    its latency is zero; being a failure it is left out of averages anyway.  A
    database with a single timer has its transaction times as connection times.
    """
    return records.withColumns({
        "connection_start": F.coalesce("connection_start", "transaction_start"),
        "connection_end": F.coalesce("connection_end", "transaction_end"),
        "transaction_start": F.coalesce("transaction_start", "connection_end"),
        "transaction_end": F.coalesce("transaction_end", "connection_end"),
    })
