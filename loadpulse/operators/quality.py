"""Checks that decide whether a series may be promoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import codes
from ..sources import snapshots, stores

JOB_FIELDS = ["db_type", "db_size", "read_pattern", "write_pattern", "read_intensity"]


def _nan() -> Column:
    return F.lit(float("nan"))


def listed_only(jobs: DataFrame, job_list: DataFrame) -> DataFrame:
    """Only jobs named in the list (warm-up runs never are)."""
    return jobs.join(job_list, "job_id", "left_semi")


def located_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with every field a location needs, with their ``key`` and ``pattern``."""
    return (
        jobs.na.drop(subset=JOB_FIELDS)
        .withColumn("key", codes.db_key(F.col("db_type"), F.col("db_size"), F.col("read_intensity")))
        .withColumn("pattern", codes.pattern_key(F.col("read_pattern"), F.col("write_pattern")))
        .where(F.col("key").isNotNull())
    )


def series_with_job(series: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each series row with its job's location; rows of unlocated jobs are skipped."""
    return series.join(located_jobs(jobs).select("job_id", "key", "pattern"), "job_id")


def skipped_jobs(job_list: DataFrame, jobs: DataFrame) -> DataFrame:
    """Listed jobs that have no row, or a row with a field missing."""
    return job_list.join(located_jobs(jobs), "job_id", "left_anti")


def series_extent(series: DataFrame) -> DataFrame:
    """Rows, first and last timestamp and span of each job's series.

    Minimum and maximum are independent of the order rows are read in, so a
    series whose first-read row is its last in time has its true span.
    """
    return (
        series.groupBy("job_id")
        .agg(
            F.count("*").alias("row_count"),
            F.min("timestamp").alias("first_timestamp"),
            F.max("timestamp").alias("last_timestamp"),
        )
        .withColumn("span_ms", F.col("last_timestamp") - F.col("first_timestamp"))
    )


def _judged_latency(ignore_nan: bool) -> Column:
    latency = F.col("average_latency")
    return F.when(~F.isnan(latency), latency) if ignore_nan else latency


def _z(value: Column, mean: Column, deviation: Column) -> Column:
    """Distance from the mean in deviations; NaN where there is no deviation.

    A NaN anywhere in the series makes mean and deviation NaN, and with them z.
    """
    return F.when(deviation == 0, _nan()).otherwise((value - mean) / deviation)


def _beyond(z: Column, limit: float) -> Column:
    # NaN sorts above every number, so it has to be excluded by name.
    return ~F.isnan(z) & (F.abs(z) > limit)


def series_zscores(series: DataFrame, ignore_nan: bool = False) -> DataFrame:
    """Mean, population deviation and z-score of latency within each job.

    One pass aggregates per job.  The moments are stored before they are joined back:
    few are broadcast, and for many the join is of plain tables, so a job with most of
    the rows is split by adaptive execution.  With
    ``ignore_nan`` rows without an average take no part instead of spoiling
    their job.
    """
    judged = _judged_latency(ignore_nan)
    moments = series.groupBy("job_id").agg(
        F.avg(judged).alias("mean"), F.stddev_pop(judged).alias("deviation"))
    return (
        series.join(stores.stored(moments, "moments"), "job_id")
        .withColumn("z", F.coalesce(_z(judged, F.col("mean"), F.col("deviation")), _nan()))
    )


def series_outliers(
    series: DataFrame, limit: float = K.Z_SCORE_LIMIT, ignore_nan: bool = False
) -> DataFrame:
    """Rows whose latency is more than ``limit`` deviations from their job's mean."""
    return series_zscores(series, ignore_nan).where(_beyond(F.col("z"), limit))


def validate_series(
    series: DataFrame,
    jobs: DataFrame,
    job_list: DataFrame,
    minimum_rows: int = K.MINIMUM_ROWS,
    minimum_span_ms: int = K.MINIMUM_SPAN_MS,
    z_limit: float = K.Z_SCORE_LIMIT,
    ignore_nan: bool = False,
) -> DataFrame:
    """One verdict per listed and located job, with all its reasons.

    z is monotonic in latency, so a job has an outlier exactly if its smallest or
    largest latency is one: a single aggregate per job is enough.  A row without
    a timestamp fails its own job only.  A listed job without series fails on
    its row count.
    """
    judged = _judged_latency(ignore_nan)
    per_job = series.groupBy("job_id").agg(
        F.count("*").alias("row_count"),
        (F.count("*") - F.count("timestamp")).alias("untimed_rows"),
        (F.max("timestamp") - F.min("timestamp")).alias("span_ms"),
        F.avg(judged).alias("mean"),
        F.stddev_pop(judged).alias("deviation"),
        F.min(judged).alias("lowest"),
        F.max(judged).alias("highest"),
    )
    return _verdicts(per_job, jobs, job_list, minimum_rows, minimum_span_ms, z_limit)


def _verdicts(per_job: DataFrame, jobs: DataFrame, job_list: DataFrame, minimum_rows: int,
              minimum_span_ms: int, z_limit: float) -> DataFrame:
    """Verdicts from a row per job: its counts, span, mean, deviation and extremes."""
    mean, deviation = F.col("mean"), F.col("deviation")
    # A job listed twice is judged once, at its first place.
    listed = job_list.groupBy("job_id").agg(F.min("seq").alias("seq"))
    candidates = located_jobs(jobs).select("job_id", "key", "pattern").join(listed, "job_id")
    has_outlier = F.coalesce(
        _beyond(_z(F.col("lowest"), mean, deviation), z_limit)
        | _beyond(_z(F.col("highest"), mean, deviation), z_limit),
        F.lit(False),
    )
    return (
        candidates.join(per_job, "job_id", "left")
        .select(
            "job_id", "key", "pattern", "seq",
            F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
            F.coalesce("span_ms", F.lit(0)).cast("bigint").alias("span_ms"),
            (F.coalesce("row_count", F.lit(0)) >= minimum_rows).alias("enough_rows"),
            (F.coalesce("span_ms", F.lit(0)) >= minimum_span_ms).alias("long_enough"),
            (~has_outlier).alias("no_outliers"),
            (F.coalesce("untimed_rows", F.lit(0)) == 0).alias("all_timed"),
        )
        .withColumn("passed", F.col("enough_rows") & F.col("long_enough")
                    & F.col("no_outliers") & F.col("all_timed"))
    )


# --- moments ------------------------------------------------------------------

MOMENTS = T.StructType([
    T.StructField("job_id", T.StringType()),
    *[T.StructField(name, T.LongType()) for name in (
        "row_count", "untimed_rows", "nan_rows", "first_timestamp", "last_timestamp", "judged")],
    *[T.StructField(name, T.DoubleType()) for name in ("mean", "m2", "lowest", "highest")],
])
MOMENT_SLOTS = 16


def series_moments(series: DataFrame) -> DataFrame:
    """What verdicts need of each job's series, in a form that can be merged.

    ``judged`` rows have a latency that is a number; ``m2`` is the sum of their squared
    distances from their ``mean``.  Rows whose latency is NaN are counted apart.
    """
    latency = F.col("average_latency")
    judged = F.when(~F.isnan(latency), latency)
    return series.groupBy("job_id").agg(
        F.count("*").alias("row_count"),
        (F.count("*") - F.count("timestamp")).alias("untimed_rows"),
        F.count(F.when(F.isnan(latency), 1)).alias("nan_rows"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.count(judged).alias("judged"), F.avg(judged).alias("mean"),
        (F.var_pop(judged) * F.count(judged)).alias("m2"),
        F.min(judged).alias("lowest"), F.max(judged).alias("highest"),
    )


def merged_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """The moments of both parts of each job's series, each with one row per job.

    The distance of the means enters by itself, so nothing cancels however far the
    latencies are from zero.  Jobs of either side are kept.
    """
    left, right = a.alias("a"), b.alias("b")

    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def total(name: str) -> Column:
        return F.coalesce(of("a", name), F.lit(0)) + F.coalesce(of("b", name), F.lit(0))

    n_a, n_b = (F.coalesce(of(side, "judged"), F.lit(0)) for side in "ab")
    both = (n_a > 0) & (n_b > 0)
    distance = of("b", "mean") - of("a", "mean")
    share = n_b / (n_a + n_b)
    return left.join(right, "job_id", "full").select(
        "job_id", *[total(name).alias(name) for name in ("row_count", "untimed_rows", "nan_rows")],
        F.least(of("a", "first_timestamp"), of("b", "first_timestamp")).alias("first_timestamp"),
        F.greatest(of("a", "last_timestamp"), of("b", "last_timestamp")).alias("last_timestamp"),
        total("judged").alias("judged"),
        F.when(both, of("a", "mean") + distance * share)
         .otherwise(F.coalesce(of("a", "mean"), of("b", "mean"))).alias("mean"),
        F.when(both, of("a", "m2") + of("b", "m2") + distance * distance * n_a * share)
         .otherwise(F.coalesce(of("a", "m2"), of("b", "m2"))).alias("m2"),
        F.least(of("a", "lowest"), of("b", "lowest")).alias("lowest"),
        F.greatest(of("a", "highest"), of("b", "highest")).alias("highest"),
    )


def keep_moments(appended: DataFrame, path: str, writer: str, update: int) -> bool:
    """Merge the moments of newly appended series rows into the table at ``path``.

    It has one row per job, so a verdict reads no series.  Only jobs that were appended
    to are merged, and only their slots are rewritten.  An append that runs again, known
    by its writer's number, changes nothing; the result says whether it was applied.
    """
    spark = appended.sparkSession
    new, new_at = stores.stored_at(series_moments(appended), "moments")
    try:
        while True:
            number = snapshots.current(spark, path)["number"]
            held = snapshots.read_snapshot(spark, path, MOMENTS)
            merged = merged_moments(held.join(new.select("job_id"), "job_id", "left_semi"), new)
            merged, merged_at = stores.stored_at(merged, "moments")
            try:
                return snapshots.upsert(
                    merged, path, ["job_id"], F.pmod(F.xxhash64("job_id"), F.lit(MOMENT_SLOTS)),
                    writer, update, expected=number)
            except snapshots.VersionConflict:
                continue  # another writer came first: merge with what it left
            finally:
                snapshots.delete(spark, merged_at)
    finally:
        snapshots.delete(spark, new_at)


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read_snapshot(spark, path, MOMENTS)


def validate_moments(
    moments: DataFrame,
    jobs: DataFrame,
    job_list: DataFrame,
    minimum_rows: int = K.MINIMUM_ROWS,
    minimum_span_ms: int = K.MINIMUM_SPAN_MS,
    z_limit: float = K.Z_SCORE_LIMIT,
    ignore_nan: bool = False,
) -> DataFrame:
    """The verdicts of ``validate_series``, from kept moments instead of the series."""
    spoilt = F.lit(False) if ignore_nan else F.col("nan_rows") > 0
    deviation = F.sqrt(F.col("m2") / F.col("judged"))
    per_job = moments.select(
        "job_id", "row_count", "untimed_rows",
        (F.col("last_timestamp") - F.col("first_timestamp")).alias("span_ms"),
        F.when(spoilt, _nan()).otherwise(F.col("mean")).alias("mean"),
        F.when(spoilt, _nan()).otherwise(F.when(F.col("judged") > 0, deviation)).alias("deviation"),
        "lowest", "highest")
    return _verdicts(per_job, jobs, job_list, minimum_rows, minimum_span_ms, z_limit)


def batch_verdict(verdicts: DataFrame) -> DataFrame:
    """Whether every judged job passed (skipped jobs have no verdict and no say)."""
    return verdicts.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))
