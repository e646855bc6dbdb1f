"""Structured Streaming jobs: the batch operators over unbounded messages.

A window's result is emitted once, when the watermark passes its end; records
of a closed window are dropped.  The watermark moves with data only, so the
newest window stays open until something later arrives: ``heartbeat`` supplies
that on a topic that goes quiet.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from .. import constants as K
from .. import schemas
from ..operators import parse, pool, windows
from ..session import state_settings
from ..sources import snapshots, stores, tables

NO_DELAY = "0 seconds"


def union_of_topics(topics: list[DataFrame], idle: str, delay: str = NO_DELAY) -> DataFrame:
    """The messages of several topics as one stream that waits for the slowest of them.

    Each topic has a watermark of its own and the lowest one counts, so a topic that is
    read behind the others loses nothing.  One that goes quiet would hold back every
    window: a topic therefore counts as having come to ``idle`` behind the newest message
    of any topic, by event time, whether it says something or not.  What it publishes
    after that with older times is late.  ``delay`` is how late a record may be within
    its topic.

    The times of all topics are read once for each topic, without their texts; topics
    are few.  Streams of the result start under ``slowest_input``.
    """
    def times(topic: DataFrame) -> DataFrame:
        return topic.select((F.col("publish_time") - F.expr(f"interval {idle}")).alias("publish_time"),
                            F.lit("[]").alias("data"))

    beats = [times(topic) for topic in topics]

    def watermarked(topic: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [topic, *beats]).withWatermark("publish_time", delay)

    return reduce(DataFrame.unionByName, map(watermarked, topics))


def slowest_input(spark: SparkSession) -> AbstractContextManager[None]:
    """Streams that start inside follow the lowest of their inputs' watermarks, whatever
    the session says; the checkpoint keeps it."""
    return state_settings(spark, **{"spark.sql.streaming.multipleWatermarkPolicy": "min"})


def stream_windowed_latency_failure(
    messages: DataFrame, width: str = K.RESULT_WINDOW, delay: str | None = NO_DELAY
) -> DataFrame:
    """The series as an unbounded result; ``delay`` is how late a record may be, or None
    for messages that have their watermark already.

    The watermark is set on the messages, before parsing, so a message without
    records moves it too.
    """
    if delay is not None:
        messages = messages.withWatermark("publish_time", delay)
    records = parse.parse_messages(messages)
    return windows.windowed_latency_failure(records, width)


def stream_sql_windowed_latency(
    messages: DataFrame, width: str = K.PROTOTYPE_WINDOW, delay: str = NO_DELAY
) -> DataFrame:
    """The SQL prototype's result as an unbounded one."""
    records = parse.parse_objects(messages.withWatermark("publish_time", delay), strict=False)
    return windows.sql_windowed_latency(records, width)


def stream_batched_messages(
    messages: DataFrame, interval: str = K.PUBLISH_INTERVAL, parts: int = 1, delay: str = NO_DELAY
) -> DataFrame:
    """The records of unbounded messages, batched anew: one JSON-array message per
    interval and publisher, given out once the watermark has passed the interval's end.

    Open intervals are lists in the state, one for each of ``parts`` of a publisher's
    interval, so a list is as long as that.  Records are dealt to parts by a hash of
    their content, the same whenever a batch runs again; copies of one record stay
    together.  A record of a closed interval is dropped.
    """
    records = parse.parse_messages(messages.withWatermark("publish_time", delay))
    fields = schemas.TRANSACTION.fieldNames()
    part = F.lit(0) if parts == 1 else F.pmod(F.xxhash64("publish_time", *fields), F.lit(parts))
    return (
        records.groupBy(F.window("publish_time", interval).alias("w"), "workload_id", part.alias("part"))
        .agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("data"))
        .select(F.col("w.start").alias("publish_time"), "workload_id", "data")
    )


def start_message_sink(
    messages: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append closed messages as files, exactly once: a batch that runs again replaces
    its own files in the sink's log."""
    return _started(
        messages.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval)), messages.sparkSession)


def heartbeat(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Messages without records at the current time; union them to a quiet stream."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(F.col("timestamp").alias("publish_time"), F.lit("[]").alias("data"))


def _trigger(interval: str | None) -> dict:
    """Run over what there is and stop, or keep going every ``interval``."""
    return {"availableNow": True} if interval is None else {"processingTime": interval}


def _started(stream: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a stream that has state, with the settings its state needs."""
    with state_settings(spark):
        return stream.start()


def read_open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows a series stream has not closed yet, with their numbers so far, as its
    last committed batch left them in the checkpoint.

    The stream may be stopped or running.  Closed windows are not in it any more.
    """
    numbers = "struct<latency_sum:double,successes:bigint,total:bigint>"
    return (
        spark.read.format("statestore").load(checkpoint)
        .select("key.*", F.col("value").cast(numbers).alias("n"))
        .select("job_id", F.col("operation").alias("query_action"),
                F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n.*")
    )


def start_series_sink(
    series: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append each window result under its job, exactly once.

    A batch's windows of one job, few as they are, go to one task and so to one file.
    The file sink's log and the checkpoint make a batch that runs again replace
    its own files, so (job, action, timestamp) stays unique.
    """
    return _started(
        series.repartition("job_id").writeStream.format("parquet").outputMode("append")
        .partitionBy("job_id")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval)), series.sparkSession)


SERIES_KEY = ["job_id", "query_action", "timestamp"]
SLOT_MS = 3_600_000  # a slot of the upsert table: what an update of it rewrites


def _series_slot(slot_ms: int) -> Column:
    return F.floor(F.col("timestamp") / slot_ms)


def start_series_upserts(
    series: DataFrame, path: str, checkpoint: str, interval: str | None = None,
    slot_ms: int = SLOT_MS,
) -> StreamingQuery:
    """Keep open windows visible: every batch puts the windows it changed in a table
    with one row per window.

    A batch rewrites only the time slots it touches and becomes visible at once, as the
    table's next version; a batch that runs again finds itself there and changes nothing.
    ``read_latest_series`` gives the current state of each window.
    """
    def write(batch: DataFrame, number: int) -> None:
        # Read twice, for its slots and for its rows: aggregate it once.
        kept, where = stores.stored_at(batch, "upserts")
        snapshots.upsert(kept, path, SERIES_KEY, _series_slot(slot_ms), checkpoint, number)
        snapshots.delete(batch.sparkSession, where)

    return _started(
        series.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**_trigger(interval)), series.sparkSession)


def read_latest_series(
    spark: SparkSession, path: str, between_ms: tuple[int, int] | None = None,
    slot_ms: int = SLOT_MS,
) -> DataFrame:
    """The newest state of each window written by ``start_series_upserts``, or of those
    with timestamps from one to another; slots outside are not read."""
    if between_ms is None:
        return snapshots.read_snapshot(spark, path, schemas.SERIES)
    first, last = between_ms
    return snapshots.read_snapshot(
        spark, path, schemas.SERIES, (first // slot_ms, last // slot_ms)
    ).where(F.col("timestamp").between(first, last))


class ElementsLost(RuntimeError):
    """The outcomes of a batch do not add up to what its messages held."""


def start_parse_with_quarantine(
    messages: DataFrame, path: str, checkpoint: str, interval: str | None = None,
) -> StreamingQuery:
    """Split every batch into usable records and everything else, in one pass.

    Each text is read once and both outcomes are one write, in folders of the batch and
    the outcome; a batch that runs again replaces its own.  What was read and what was
    kept is observed on the way: a batch whose sums differ fails, and the numbers of the
    others are kept beside their rows (``read_split_counts``).
    """
    def write(batch: DataFrame, number: int) -> None:
        read, kept = Observation(f"read-{number}"), Observation(f"kept-{number}")
        parse.split_messages(batch, read, kept).write.mode("overwrite").partitionBy("outcome").parquet(
            f"{path}/split/batch={number}")
        counts = read.get | kept.get
        if counts["elements"] != counts[parse.ACCEPTED] + counts[parse.BAD_RECORD] + counts[parse.BAD_MESSAGE]:
            raise ElementsLost(f"batch {number}: {counts}")
        tables.fixed_table(batch.sparkSession, [tuple(counts[c] for c in SPLIT_COUNTS)],
                           dict.fromkeys(SPLIT_COUNTS, "BIGINT")).write.mode("overwrite").parquet(
            f"{path}/counts/batch={number}")

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**_trigger(interval)).start()
    )


SPLIT_COUNTS = ["messages", "elements", parse.ACCEPTED, parse.BAD_RECORD, parse.BAD_MESSAGE]


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``start_parse_with_quarantine``; a filter on ``outcome`` or ``batch``
    reads only its folders."""
    return spark.read.schema(schemas.SPLIT).parquet(f"{path}/split")


def read_split_counts(spark: SparkSession, path: str) -> DataFrame:
    """What each batch read and kept: a row per batch."""
    columns = ", ".join(f"{c} bigint" for c in [*SPLIT_COUNTS, "batch"])
    return spark.read.schema(columns).parquet(f"{path}/counts")


def start_lease_sweep(
    ticks: DataFrame, load_resources: Callable[[SparkSession], DataFrame], path: str,
    checkpoint: str, interval: str | None = K.SWEEP_INTERVAL,
) -> StreamingQuery:
    """At every tick write the leased resources that have expired by then.

    ``ticks`` has a ``timestamp`` column (a rate source will do); the newest one of
    a batch is its ``now``.  The resource table is read anew each time.
    """
    def sweep(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        if now is None:
            return
        expired = pool.expired_leases(load_resources(batch.sparkSession), now / 1e6)
        expired.write.mode("overwrite").parquet(f"{path}/sweep={number}")

    return (
        ticks.writeStream.foreachBatch(sweep)
        .option("checkpointLocation", checkpoint).trigger(**_trigger(interval)).start()
    )


RESOURCE_SLOTS = 64


def start_resource_state(
    resources: DataFrame, log: DataFrame, path: str, checkpoint: str, interval: str | None = None,
) -> StreamingQuery:
    """Keep the state of leased resources from an unbounded log of status changes
    (resource_id, seq, status, expiry), in a table with one row per resource.

    The state of a resource is its last change by ``seq`` and its last lease, with their
    numbers, whatever batch they came in: a change that arrives late, or again, cannot
    undo a later one.  Of changes with one number the greatest status counts; a change
    without a number gives way to any with one.  The state has a row per resource that
    ever changed; changes of unknown resources do nothing to the table.

    ``resources`` is what the table begins with; it is read only if there is no table.
    """
    snapshots.upsert(resources.select(*schemas.RESOURCE.fieldNames()), path, ["resource_id"],
                     _resource_slot(), "resources", 0)
    lease = F.when(F.col("status") == "leased", F.struct("seq", "expiry"))
    latest = log.groupBy("resource_id").agg(
        F.max(F.struct("seq", "status")).alias("change"), F.max(lease).alias("lease"))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed, where = stores.stored_at(
            read_resource_state(spark, path).join(batch, "resource_id")
            .withColumn("status", F.coalesce("change.status", "status"))
            .withColumn("expiry", F.coalesce("lease.expiry", "expiry"))
            .select(*schemas.RESOURCE.fieldNames()), "changed")
        snapshots.upsert(changed, path, ["resource_id"], _resource_slot(), checkpoint, number)
        snapshots.delete(spark, where)

    return _started(
        latest.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**_trigger(interval)), latest.sparkSession)


def _resource_slot() -> Column:
    return F.pmod(F.xxhash64("resource_id"), F.lit(RESOURCE_SLOTS))


def read_resource_state(spark: SparkSession, path: str) -> DataFrame:
    """The resources as the changes so far have left them."""
    return snapshots.read_snapshot(spark, path, schemas.RESOURCE)
