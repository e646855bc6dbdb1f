"""Queries over the table of leased database resources.

``now`` is always a parameter (epoch seconds), so a result can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K

POOL = ["database_type", "database_size"]
CONNECTION = ["connection_string", "replica_ip"]
EXPIRY_OF_NEW = -10  # seconds relative to now: a new resource counts as expired


def status_filters(resources: DataFrame, now: float) -> DataFrame:
    """One row per resource and condition it meets: down, ready or expired."""
    conditions = {
        "down": F.col("status") == "down",
        "ready": F.col("status") == "ready",
        "expired": F.col("expiry") < now,
    }
    met = F.array_compact(F.array(*[F.when(c, name) for name, c in conditions.items()]))
    return resources.select("resource_id", F.explode(met).alias("condition"))


def expired_leases(resources: DataFrame, now: float) -> DataFrame:
    """Leased resources whose lease is over: the set a sweep cleans."""
    return resources.where((F.col("status") == "leased") & (F.col("expiry") < now))


def earliest_expiry(resources: DataFrame) -> DataFrame:
    """The one resource that expires first (ties by id)."""
    return resources.orderBy("expiry", "resource_id").limit(1)


def lease_candidate(resources: DataFrame) -> DataFrame:
    """Per pool the resource that expires first, provided it is ready.

    Only the earliest one is looked at: while it is being cleaned its pool has no
    candidate, even if others are ready.  ``expiry`` is the one before leasing.
    """
    earliest = resources.groupBy(*POOL).agg(
        F.min(F.struct("expiry", "resource_id", "status", *CONNECTION)).alias("first"))
    return earliest.where(F.col("first.status") == "ready").select(
        *POOL, "first.resource_id", "first.expiry", *[f"first.{name}" for name in CONNECTION])


def pool_status(resources: DataFrame) -> DataFrame:
    """Resources per pool and status, and whether the pool has a ready one."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in K.STATUSES]
    return (
        resources.groupBy(*POOL).agg(*counts)
        .withColumn("available", F.col("ready") > 0)
    )


def resource_state_after(resources: DataFrame, log: DataFrame) -> DataFrame:
    """Resources after a log of status changes (resource_id, seq, status, expiry).

    The last change gives the status; only a lease sets an expiry.  Changes of
    unknown resources do nothing.
    """
    lease = F.col("status") == "leased"
    latest = log.groupBy("resource_id").agg(
        F.max_by("status", "seq").alias("new_status"),
        F.max_by(F.when(lease, F.col("expiry")), F.when(lease, F.col("seq"))).alias("new_expiry"),
    )
    return (
        resources.join(latest, "resource_id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("expiry", F.coalesce("new_expiry", "expiry"))
        .drop("new_status", "new_expiry")
    )


def register_resources(resources: DataFrame, requests: DataFrame, now: float) -> DataFrame:
    """Outcome of every registration request: added, or already in the pool.

    Of several requests for one id the first (by ``seq``) is the one that can add
    it.  Added rows come with the state a new resource starts in.
    """
    identity = POOL + ["resource_id"]
    first = requests.groupBy(*identity).agg(F.min("seq").alias("first_seq"))
    known = resources.select(*identity, F.lit(True).alias("known"))
    fresh = first.join(known, identity, "left").select(
        *identity, "first_seq", F.coalesce("known", F.lit(False)).alias("known"))
    added = ~F.col("known") & (F.col("seq") == F.col("first_seq"))
    return (
        requests.join(fresh, identity)
        .withColumn("outcome", F.when(added, "added").otherwise("already in pool"))
        .withColumn("status", F.when(added, "ready"))
        .withColumn("expiry", F.when(added, F.lit(float(now + EXPIRY_OF_NEW))))
        .drop("first_seq", "known")
    )
