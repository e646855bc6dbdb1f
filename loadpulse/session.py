"""Session defaults and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"

# How streams keep their state: on local disk under a bounded cache, with only the
# changes of a batch going to the checkpoint.
STATE_DEFAULTS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Settings a job needs whatever the cluster size.  Partition counts and memory
# stay with the cluster's own configuration.
JOB_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    **STATE_DEFAULTS,
}


def build_session(app_name: str, **overrides: str) -> SparkSession:
    """A session with the job defaults; ``overrides`` are extra Spark settings."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**JOB_DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextlib.contextmanager
def state_settings(spark: SparkSession, **own: str) -> Iterator[None]:
    """``STATE_DEFAULTS`` for streams that start inside, where the session says nothing,
    and the settings in ``own`` whatever it says.

    A stream copies its session's settings when it starts, so they can be taken back.
    """
    before = {k: spark.conf.get(k, None) for k in {**STATE_DEFAULTS, **own}}
    wanted = {k: v for k, v in STATE_DEFAULTS.items() if before[k] is None} | own
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in wanted:
            if before[key] is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before[key])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a local session may fall back to a fresh temporary folder: on a
    cluster such a folder would be lost with the machine it is on.
    """
    configured = spark.conf.get(SHARED_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR_CONF} to a folder all executors share")
    fresh = tempfile.mkdtemp(prefix="run-")
    spark.conf.set(SHARED_DIR_CONF, fresh)
    return fresh


def new_location(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
