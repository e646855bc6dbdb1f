"""Planned load per job, and how the recorded load compares to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import codes


def _segments(pattern: Column) -> Column:
    """The (seconds, qps) segments of a pattern id; null for an unknown one."""
    table = {
        code: F.array(*[F.struct(F.lit(s).alias("seconds"), F.lit(q).alias("qps"))
                        for s, q in segments])
        for code, segments in K.LOAD_PATTERNS.items()
    }
    entries = [c for code, array in table.items() for c in (F.lit(code), array)]
    return F.try_element_at(F.create_map(*entries), pattern)


def load_segments(jobs: DataFrame, operation: str) -> DataFrame:
    """A job's segments for one operation: start, rate and planned transactions.

    A segment starts where the ones before it end.  The number of transactions is
    rounded half to even.
    """
    plan = _segments(F.col(f"{operation}_pattern"))
    started = F.aggregate(
        F.slice("plan", 1, F.col("segment")), F.lit(0), lambda sum_, s: sum_ + s["seconds"])
    return (
        jobs.select(
            "job_id",
            F.lit(operation).alias("operation"),
            codes.intensity_multiplier(F.col(f"{operation}_intensity")).alias("pods"),
            plan.alias("plan"),
        )
        .select("*", F.posexplode("plan").alias("segment", "s"))
        .select(
            "job_id", "operation", "pods", "segment",
            started.alias("start_second"),
            (1.0 / F.col("s.qps")).alias("gap"),
            F.bround(F.col("s.seconds") / (1.0 / F.col("s.qps"))).cast("int").alias("planned"),
        )
    )


def expected_load(jobs: DataFrame, operation: str) -> DataFrame:
    """Every planned transaction of one pod, as seconds from the start of the run.

    ``pods`` is how many pods run the same schedule at the same time.
    """
    return (
        load_segments(jobs, operation)
        .where(F.col("planned") > 0)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("planned") - 1)).alias("turn"))
        .select(
            "job_id", "operation", "segment", "turn",
            (F.col("start_second") + F.col("turn") * F.col("gap")).alias("offset_seconds"),
            "pods",
        )
    )


def planned_reads_and_writes(jobs: DataFrame) -> DataFrame:
    """The read schedule and the write schedule of every job together."""
    return expected_load(jobs, "read").unionByName(expected_load(jobs, "write"))


def expected_vs_observed(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """Planned and recorded transactions per job and operation, either side may lack one.

    Planned counts come from the segments; no schedule is unfolded for them.
    """
    planned = load_segments(jobs, "read").unionByName(load_segments(jobs, "write"))
    expected = planned.groupBy("job_id", "operation").agg(
        F.sum(F.col("planned").cast("bigint") * F.col("pods")).alias("expected"))
    observed = records.groupBy("job_id", "operation").agg(F.count("*").alias("observed"))
    return (
        expected.join(observed, ["job_id", "operation"], "full_outer")
        .select(
            "job_id", "operation",
            F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
            F.coalesce("observed", F.lit(0)).cast("bigint").alias("observed"),
        )
    )
