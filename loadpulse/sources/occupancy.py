"""What a cache holds, without reading it: an index of its locations, and claims on them.

The index is a small keyed table beside the cache's folders, one row per (key, pattern,
seed), brought up to date by every ``append``.  A claim is a file that only one writer
can create; who has it may fill the location.  Both lie in folders that readers of the
cache skip.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterable
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import snapshots, stores

# ``seed`` is the empty text for rows without one: a key of the index cannot be null.
PLACE = ["key", "pattern", "seed"]
INDEX = T.StructType([
    *[T.StructField(name, T.StringType()) for name in PLACE],
    T.StructField("cached_rows", T.LongType()),
    T.StructField("first_timestamp", T.LongType()),
    T.StructField("last_timestamp", T.LongType()),
])
_ATTEMPTS = 50


class Place(tuple):
    """A location: key, pattern and seed (empty for none)."""

    def __new__(cls, key: str, pattern: str, seed: object | None = None) -> Place:
        return super().__new__(cls, (key, pattern, "" if seed is None else str(seed)))


def _index_path(path: str) -> str:
    return f"{path}/_occupancy"


def within(places: Iterable[tuple], no_seed: str | None = None) -> Column:
    """A predicate of literals, which prunes folders: rows at one of the places.

    ``no_seed`` is what rows without a seed have in that column: null in a cache.
    """
    def at(place: tuple) -> Column:
        key, pattern, seed = place
        seed = F.col("seed").isNull() if seed == "" and no_seed is None else F.col("seed") == seed
        return (F.col("key") == key) & (F.col("pattern") == pattern) & seed

    return reduce(lambda a, b: a | b, map(at, places), F.lit(False))


def _summary(rows: DataFrame) -> DataFrame:
    seed = F.coalesce(F.col("seed").cast("string"), F.lit("")) if "seed" in rows.columns else F.lit("")
    return rows.groupBy("key", "pattern", seed.alias("seed")).agg(
        F.count("*").alias("cached_rows"), F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"))


def occupancy(spark: SparkSession, path: str) -> DataFrame:
    """The index of the cache at ``path``: a row per location that has rows.

    A cache that was filled without an index gets one here, from one reading of it, before
    anything is added.
    """
    if snapshots.current(spark, _index_path(path))["number"] == 0:
        try:
            rows = stores.read_cached_series(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], stores.CACHE)
        with contextlib.suppress(snapshots.VersionConflict):  # another one has made it
            snapshots.upsert(_summary(rows), _index_path(path), PLACE, F.lit(0), expected=0)
    return snapshots.read_snapshot(spark, _index_path(path), INDEX)


def occupied(spark: SparkSession, path: str) -> set[Place]:
    """The locations of the index.  A campaign has a few hundred, times its seeds."""
    return {Place(*row) for row in occupancy(spark, path).select(*PLACE).collect()}


def _add(summary: DataFrame, path: str) -> None:
    """Add a summary of appended rows to the index.

    The appended locations, a row each, are added up on the driver.  Of writers at the
    same version all but one begin anew, on what the others left.
    """
    spark = summary.sparkSession
    added = {tuple(r[c] for c in PLACE): r for r in summary.collect()}
    if not added:
        return
    for _ in range(_ATTEMPTS):
        held = snapshots.read_snapshot(spark, _index_path(path), INDEX).where(within(added, no_seed=""))
        rows = {place: (r["cached_rows"], r["first_timestamp"], r["last_timestamp"]) for place, r in added.items()}
        for r in held.collect():
            n, first, last = rows[tuple(r[c] for c in PLACE)]
            rows[tuple(r[c] for c in PLACE)] = (
                n + r["cached_rows"], _least(first, r["first_timestamp"], min),
                _least(last, r["last_timestamp"], max))
        after = spark.createDataFrame([(*place, *numbers) for place, numbers in rows.items()], INDEX)
        with contextlib.suppress(snapshots.VersionConflict):
            snapshots.upsert(after, _index_path(path), PLACE, F.lit(0), slots=[0])
            return
    raise snapshots.VersionConflict(f"the index of {path} changes all the time")


def _least(a: int | None, b: int | None, choose) -> int | None:
    known = [v for v in (a, b) if v is not None]
    return choose(known) if known else None


def append(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Append rows to the cache at ``path`` and to its index."""
    occupancy(rows.sparkSession, path)  # an older cache is indexed before it grows
    stores.append_partitioned(rows, path, partitions)
    _add(_summary(rows), path)


def read_places(spark: SparkSession, path: str, places: Iterable[tuple]) -> DataFrame:
    """The cache's rows at some of its locations; other folders are not read."""
    return stores.read_cached_series(spark, path).where(within(places))


# --- claims -----------------------------------------------------------------------

def _claim_path(path: str, place: Place) -> str:
    return f"{path}/_claims/" + "/".join(quote(v, safe="") or "-" for v in place)


def claim(spark: SparkSession, path: str, place: Place, owner: str) -> bool:
    """Whether ``owner`` has the location: by this call, or by an earlier one."""
    where = _claim_path(path, place)
    if snapshots.publish(spark, where, json.dumps({"owner": owner, "place": place})):
        return True
    held = snapshots.read_small(spark, where)
    return held is not None and json.loads(held)["owner"] == owner


def release(spark: SparkSession, path: str, places: Iterable[Place], owner: str) -> None:
    """Give up the claims of ``owner`` on these locations."""
    for place in places:
        held = snapshots.read_small(spark, _claim_path(path, place))
        if held is not None and json.loads(held)["owner"] == owner:
            snapshots.delete(spark, _claim_path(path, place))


def abandoned(spark: SparkSession, path: str) -> dict[Place, str]:
    """Claimed locations without rows, with their owners: writers at work, or dead ones,
    whose claims ``release`` frees."""
    filled, found = occupied(spark, path), {}
    for key in snapshots.names_in(spark, f"{path}/_claims"):
        for pattern in snapshots.names_in(spark, f"{path}/_claims/{key}"):
            for seed in snapshots.names_in(spark, f"{path}/_claims/{key}/{pattern}"):
                held = snapshots.read_small(spark, f"{path}/_claims/{key}/{pattern}/{seed}")
                if held is not None:
                    held = json.loads(held)
                    found[Place(*held["place"])] = held["owner"]
    return {place: owner for place, owner in found.items() if place not in filled}
