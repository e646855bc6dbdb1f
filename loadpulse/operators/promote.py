"""Promotion of validated series: run store -> staging cache -> live cache."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..sources import occupancy, stores
from ..sources.occupancy import Place
from ..sources.tables import fixed_table

LOCATION = ["key", "pattern"]


class SeedInUse(ValueError):
    """The live cache already has rows with the seed of a copy."""


def not_already_cached(candidates: DataFrame, occupied: DataFrame) -> DataFrame:
    """Candidates whose location is still empty.

    ``occupied`` has a row per location, as the index of a cache does
    (``sources.occupancy``), or rows of the cache itself, which are summed up first.
    """
    return candidates.join(occupied.select(*LOCATION).distinct(), LOCATION, "left_anti")


def first_wins(verdicts: DataFrame) -> DataFrame:
    """For each location the first listed job that passed."""
    return (
        verdicts.where("passed").groupBy(*LOCATION)
        .agg(F.min_by("job_id", "seq").alias("job_id"))
    )


def promoted_rows(series: DataFrame, winners: dict[str, tuple[str, str]]) -> DataFrame:
    """The series rows of the winning jobs, with the location each is promoted to.

    Jobs are named by literals, so a store with a folder per job is read there only, and
    their locations are a local relation of known size.
    """
    spark = series.sparkSession
    if not winners:
        return spark.createDataFrame([], stores.CACHE).drop("seed")
    places = fixed_table(spark, [(job, *place) for job, place in sorted(winners.items())],
                         {"job_id": "STRING", "key": "STRING", "pattern": "STRING"})
    return series.where(F.col("job_id").isin(sorted(winners))).join(places, "job_id")


def promote_to_stage(
    spark: SparkSession, series: DataFrame, verdicts: DataFrame, stage_path: str,
    owner: str | None = None,
) -> None:
    """Append the series of the first passing job of every empty location to the staging
    cache at ``stage_path``.

    The cache's index tells which locations are empty, so the cache itself is not read.
    Each location is claimed before it is filled: of promotions that run at once, one
    fills it.  A promotion that fails gives its claims back; one that dies leaves them
    (``occupancy.abandoned``), and goes on if it runs again as the same ``owner``.
    Candidates come to the driver: one per location that the listed jobs name.
    """
    owner = owner or uuid.uuid4().hex
    filled = occupancy.occupied(spark, stage_path)
    candidates = {r["job_id"]: Place(r["key"], r["pattern"]) for r in first_wins(verdicts).collect()}
    claimed = {job: place for job, place in candidates.items()
               if place not in filled and occupancy.claim(spark, stage_path, place, owner)}
    # What another promotion has filled and indexed since the first look is not ours.
    filled = occupancy.occupied(spark, stage_path) if claimed else filled
    winners = {job: place[:2] for job, place in claimed.items() if place not in filled}
    if not winners:
        return
    try:
        occupancy.append(promoted_rows(series, winners), stage_path, stores.CACHE_PARTITIONS)
    except Exception:
        occupancy.release(spark, stage_path, claimed.values(), owner)
        raise


def with_seed(rows: DataFrame, seed: object) -> DataFrame:
    """Rows tagged with a seed.  Seeds are text: some stores hold them as numbers."""
    return rows.withColumn("seed", F.lit(str(seed)))


def seed_conflicts(staged: DataFrame, live: DataFrame, seed: object) -> DataFrame:
    """Locations of the staged rows that the live cache already has for this seed."""
    taken = live.where(F.col("seed").cast("string") == str(seed))
    return (
        staged.select(*LOCATION).distinct()
        .join(taken.select(*LOCATION).distinct(), LOCATION, "left_semi")
    )


def promote_with_seed(
    spark: SparkSession, stage_path: str, live_path: str, seed: object, owner: str | None = None
) -> None:
    """Copy the whole staging cache to the live one under ``seed``, or refuse.

    Any staged location with rows of that seed refuses the whole copy, whatever its
    pattern.  Both caches' indexes are asked, and every location is claimed before any
    is written, so of copies under one seed that run at once at most one is made.
    """
    owner = owner or uuid.uuid4().hex
    wanted = [Place(r["key"], r["pattern"], seed) for r in
              occupancy.occupancy(spark, stage_path).select(*LOCATION).distinct().orderBy(*LOCATION).collect()]
    claimed: list[Place] = []
    try:
        for place in wanted:
            if not occupancy.claim(spark, live_path, place, owner):
                raise SeedInUse(f"another copy has claimed {place} of the live cache")
            claimed.append(place)
        if not occupancy.occupied(spark, live_path).isdisjoint(wanted):
            raise SeedInUse(f"live cache already has rows with seed {seed}")
        staged = stores.read_cached_series(spark, stage_path).drop("seed")
        occupancy.append(with_seed(staged, seed), live_path, stores.LIVE_CACHE_PARTITIONS)
    except Exception:
        occupancy.release(spark, live_path, claimed, owner)
        raise


def all_locations(spark: SparkSession) -> DataFrame:
    """Every (key, pattern) a full campaign covers: 27 instances by 9 patterns."""
    digits = F.sequence(F.lit(1), F.lit(3))
    prefixes = fixed_table(spark, [(p,) for p in K.KEY_PREFIX.values()], {"prefix": "STRING"})
    return (
        prefixes
        .withColumn("db_size", F.explode(digits)).withColumn("intensity", F.explode(digits))
        .withColumn("read_pattern", F.explode(digits)).withColumn("write_pattern", F.explode(digits))
        .select(
            F.concat_ws("-", "prefix", "db_size", "intensity").alias("key"),
            F.concat_ws("-", "read_pattern", "write_pattern").alias("pattern"),
        )
    )


def missing_runs(spark: SparkSession, cached: DataFrame) -> DataFrame:
    """Locations of a full campaign that have no rows yet."""
    return not_already_cached(all_locations(spark), cached)


def first_run_per_instance(jobs: DataFrame) -> DataFrame:
    """Jobs with ``warm_up`` set on the first started one of each (type, size).

    ``jobs`` needs a ``start`` column; equal starts are told apart by job id.
    """
    first = jobs.groupBy("db_type", "db_size").agg(
        F.min(F.struct("start", "job_id")).alias("first"))
    return (
        jobs.join(first, ["db_type", "db_size"])
        .withColumn("warm_up", F.col("job_id") == F.col("first.job_id"))
        .drop("first")
    )
