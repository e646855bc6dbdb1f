"""Run requests and registrations as tables: checks, expansion, cache lookup.

Request fields are text as they arrive; an absent field is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..sources import occupancy

REQUIRED = {
    "single": ["read_pattern", "write_pattern", "db_type", "intensity", "db_size"],
    "fail": ["read_pattern", "write_pattern"],
    "run": ["read_pattern", "write_pattern", "intensity", "sql_size", "sql_rep_size",
            "spanner_size"],
}
# A run against the smallest relational instance at full intensity.
FAIL_RUN = {"db_type": 1, "db_size": 1, "intensity": 3}


def _integer(name: str) -> Column:
    return F.col(name).try_cast("int")


def _per_mode(test) -> Column:
    """``test`` of every required field of a request's mode; false for other modes."""
    checked = F.lit(False)
    for mode, names in REQUIRED.items():
        every = F.lit(True)
        for name in names:
            every = every & test(name)
        checked = F.when(F.col("mode") == mode, every).otherwise(checked)
    return checked


def _first_failed(rules: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(~ok, name) for name, ok in rules])


def job_request_flags(requests: DataFrame) -> DataFrame:
    """Each request with the outcome of every rule and the first rule it breaks.

    Type and size are checked only for single runs; the other modes fix or list
    theirs.
    """
    single = F.col("mode") == "single"
    flags = requests.select(
        "*",
        _per_mode(lambda n: F.col(n).isNotNull()).alias("complete"),
        _per_mode(lambda n: _integer(n).isNotNull()).alias("integers"),
        (~single | F.coalesce(_integer("db_type").between(1, 3), F.lit(False))).alias("type_ok"),
        (~single | F.coalesce(_integer("db_size").between(1, 3), F.lit(False))).alias("size_ok"),
    )
    rules = [(name, F.col(name)) for name in ("complete", "integers", "type_ok", "size_ok")]
    first = _first_failed(rules)
    return flags.withColumn("first_failed_rule", first).withColumn("accepted", first.isNull())


def expand_run_requests(requests: DataFrame) -> DataFrame:
    """Accepted requests as job rows: one for fail and single, three for run.

    A job's id is a hash of the request and the job's place in it, so a task that
    runs again gives the same ids.
    """
    def job(db_type: Column, db_size: Column, intensity: Column) -> Column:
        return F.struct(db_type.alias("db_type"), db_size.alias("db_size"),
                        intensity.alias("intensity"))

    intensity = _integer("intensity")
    three = [job(F.lit(code), _integer(size), intensity) for code, size in
             ((1, "sql_size"), (2, "sql_rep_size"), (3, "spanner_size"))]
    fixed = job(*[F.lit(FAIL_RUN[name]) for name in ("db_type", "db_size", "intensity")])
    jobs = (
        F.when(F.col("mode") == "fail", F.array(fixed))
        .when(F.col("mode") == "run", F.array(*three))
        .otherwise(F.array(job(_integer("db_type"), _integer("db_size"), intensity)))
    )
    return (
        job_request_flags(requests).where("accepted")
        .select("*", F.posexplode(jobs).alias("slot", "job"))
        .select(
            F.md5(F.concat_ws("|", "request_id", "slot")).alias("job_id"),
            "request_id",
            "slot",
            "job.db_type",
            "job.db_size",
            _integer("read_pattern").alias("read_pattern"),
            F.col("job.intensity").alias("read_intensity"),
            _integer("write_pattern").alias("write_pattern"),
            F.col("job.intensity").alias("write_intensity"),
        )
    )


def cached_locations(requests: DataFrame) -> DataFrame:
    """The cache locations (key, pattern) that answer a fail or run request."""
    return (
        expand_run_requests(requests.where(F.col("mode").isin("fail", "run")))
        .select(
            "request_id",
            codes.db_key(F.col("db_type"), F.col("db_size"), F.col("read_intensity")).alias("key"),
            codes.pattern_key(F.col("read_pattern"), F.col("write_pattern")).alias("pattern"),
        )
    )


def cached_lookup(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Each location a request asks for, with what the cache holds there.

    The cache is summed up per location first: a location many requests ask for
    is then one row to join, not its whole series times the requests.
    """
    held = cached.groupBy("key", "pattern").agg(
        F.count("*").alias("cached_rows"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )
    return (
        cached_locations(requests).join(held, ["key", "pattern"], "left")
        .withColumn("cached_rows", F.coalesce("cached_rows", F.lit(0)).cast("bigint"))
    )


def cached_series_for(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """The cached rows that the requests ask for, each row once."""
    asked = cached_locations(requests).select("key", "pattern").distinct()
    return cached.join(asked, ["key", "pattern"], "left_semi")


def read_series_for(
    spark: SparkSession, requests: DataFrame, path: str, seed: object | None = None
) -> DataFrame:
    """The rows of the cache at ``path`` that the requests ask for, each row once.

    The cache's index says which of the asked locations it has.  Those, no more than it
    has at all, are read by literal predicates, so other folders are not listed.
    """
    asked = cached_locations(requests).select("key", "pattern").distinct()
    held = occupancy.occupancy(spark, path).where(
        F.col("seed") == ("" if seed is None else str(seed))).join(asked, ["key", "pattern"], "left_semi")
    places = [occupancy.Place(r["key"], r["pattern"], seed) for r in held.collect()]
    return occupancy.read_places(spark, path, places)


def resource_quality_flags(registry: DataFrame) -> DataFrame:
    """Registrations with the outcome of every rule and the first one broken.

    A relational resource's connection string must not start with anything but a
    digit or a dot; the third type's must equal the resource id.
    """
    present = F.lit(True)
    for name in ("database_type", "database_size", "resource_id", "connection_string"):
        present = present & F.col(name).isNotNull()
    third = F.col("database_type") == 3
    connection_ok = F.when(third, F.col("resource_id") == F.col("connection_string")).otherwise(
        ~F.col("connection_string").rlike(r"^[^0-9.]"))
    rules = {
        "complete": present,
        "type_ok": F.col("database_type").between(1, 3),
        "size_ok": F.col("database_size").between(1, 3),
        "resource_id_ok": F.col("resource_id").rlike(r"^[a-z0-9:-]+$"),
        "connection_ok": connection_ok,
        "replica_ok": (F.col("database_type") != 2) | F.col("replica_ip").isNotNull(),
    }
    flags = registry.select(
        "*", *[F.coalesce(ok, F.lit(False)).alias(name) for name, ok in rules.items()])
    first = _first_failed([(name, F.col(name)) for name in rules])
    return flags.withColumn("first_failed_rule", first).withColumn("accepted", first.isNull())
