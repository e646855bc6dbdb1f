import json
import os

import pytest
from pyspark.sql import functions as F

from message_times import T0_MS
from loadpulse import schemas, sources
from loadpulse.operators import parse, pool, windows
from loadpulse.streaming import jobs as streaming
from test_windows import assert_golden, golden_pairs, prototype_pairs


@pytest.fixture
def feed(spark, make_messages, folder):
    """Write messages as one more file of a topic folder; the folder as a stream."""
    path = folder("topic")

    def send(*pairs):
        make_messages(*pairs).coalesce(1).write.mode("append").parquet(path)

    send.path = path
    send.stream = lambda: sources.stream_messages(spark, path, maxFilesPerTrigger="1")
    return send


def message(job="j", ok=True, latency=1.0, op="read"):
    return json.dumps([dict(job_id=job, workload_id="w", operation=op, success=ok,
                            connection_start=0.0, connection_end=latency,
                            transaction_start=0.0, transaction_end=latency)])


CLOSING = (60, "[]")  # a message without records moves the watermark


def sink(spark, series, folder):
    streaming.start_series_sink(series, folder("series"), folder("progress")).awaitTermination()
    return sources.read_series(spark, folder("series"))


def test_stream_gives_the_golden_series(spark, feed, folder):
    for pair in golden_pairs():
        feed(pair)
    feed(CLOSING)
    series = streaming.stream_windowed_latency_failure(feed.stream())
    assert_golden(sink(spark, series, folder).collect())


def test_stream_equals_batch(spark, feed, folder):
    for second in range(20):
        feed((second, message(f"job-{second % 3}", ok=second % 4 > 0, latency=second / 8)),
             (second + 0.5, message(op="write")))
    feed(CLOSING)
    stream = sink(spark, streaming.stream_windowed_latency_failure(feed.stream(), "5 seconds"), folder)
    batch = windows.windowed_latency_failure(
        parse.parse_messages(sources.read_messages(spark, feed.path)), "5 seconds")
    assert stream.count() == batch.count()
    as_text = [F.col(c).cast("string") for c in stream.columns]
    assert stream.select(*as_text).exceptAll(batch.select(stream.columns).select(*as_text)).isEmpty()


def test_late_records_are_dropped_and_the_newest_window_waits(spark, feed, folder):
    feed((0, message()))
    feed((10, message()))
    feed((0.5, message()))        # late: the window of second 0 is closed
    feed((20, message()))
    series = streaming.stream_windowed_latency_failure(feed.stream())
    got = {r.timestamp: r.average_latency for r in sink(spark, series, folder).collect()}
    assert set(got) == {T0_MS + 999, T0_MS + 10_999}


def test_a_delay_lets_late_records_in(spark, feed, folder):
    feed((0, message(latency=1.0)))
    feed((10, message()))
    feed((0.5, message(latency=3.0)))
    feed(CLOSING)
    series = streaming.stream_windowed_latency_failure(feed.stream(), delay="30 seconds")
    got = {r.timestamp: r.average_latency for r in sink(spark, series, folder).collect()}
    assert got == {T0_MS + 999: 2.0, T0_MS + 10_999: 1.0}


@pytest.fixture
def second_feed(spark, make_messages, folder):
    path = folder("second")

    def send(*pairs):
        make_messages(*pairs).coalesce(1).write.mode("append").parquet(path)

    send.stream = lambda: sources.stream_messages(spark, path, maxFilesPerTrigger="1")
    return send


def timestamps(spark, feeds, folder, idle, policy="max"):
    """What a stream of two topics has given out; the session's own policy does not count."""
    name = "spark.sql.streaming.multipleWatermarkPolicy"
    spark.conf.set(name, policy)
    try:
        both = streaming.union_of_topics([f.stream() for f in feeds], idle)
        with streaming.slowest_input(spark):
            rows = sink(spark, streaming.stream_windowed_latency_failure(both, delay=None), folder).collect()
        assert spark.conf.get(name) == policy
    finally:
        spark.conf.unset(name)
    return sorted((r.timestamp - T0_MS - 999) // 1000 for r in rows)


def test_a_topic_behind_the_others_loses_nothing(spark, feed, second_feed, folder):
    for second in (0, 20, 40):
        feed((second, message()))
    for second in (3, 5, 7):          # read in the same batches, 15 to 33 seconds behind
        second_feed((second, message()))
    feed((200, "[]"))
    second_feed((200, "[]"))
    assert timestamps(spark, (feed, second_feed), folder, "60 seconds") == [0, 3, 5, 7, 20, 40]


def test_a_quiet_topic_holds_windows_back_for_its_idle_time_only(spark, feed, second_feed, folder):
    for second in (0, 20, 40, 60):
        feed((second, message()))
    second_feed((3, message()))       # and no more
    assert timestamps(spark, (feed, second_feed), folder, "25 seconds") == [0, 3, 20]
    feed((100, "[]"))
    assert timestamps(spark, (feed, second_feed), folder, "25 seconds") == [0, 3, 20, 40, 60]


def test_a_topic_that_comes_back_too_late_is_late(spark, feed, second_feed, folder):
    feed((0, message()))
    second_feed((1, message()))
    feed((50, message()))
    second_feed((2, message()))
    feed((60, message()))
    second_feed((30, message()))
    feed((70, message()))             # a batch after the one in which window 4 was closed
    second_feed((4, message()))
    feed((200, "[]"))
    got = timestamps(spark, (feed, second_feed), folder, "25 seconds")
    assert got == [0, 1, 2, 30, 50, 60, 70]


def test_restart_goes_on_without_repeating(spark, feed, folder):
    feed((0, message()))
    feed((10, message()))
    sink(spark, streaming.stream_windowed_latency_failure(feed.stream()), folder)
    feed((20, message()))
    feed(CLOSING)
    rows = sink(spark, streaming.stream_windowed_latency_failure(feed.stream()), folder).collect()
    assert sorted(r.timestamp for r in rows) == [T0_MS + 999, T0_MS + 10_999, T0_MS + 20_999]


def test_upserts_show_open_windows_and_their_latest_state(spark, feed, folder):
    feed((0, message(latency=1.0)))
    feed((0.5, message(latency=3.0)))
    series = streaming.stream_windowed_latency_failure(feed.stream())
    streaming.start_series_upserts(series, folder("up"), folder("progress")).awaitTermination()
    rows = streaming.read_latest_series(spark, folder("up")).collect()
    assert [(r.timestamp, r.average_latency) for r in rows] == [(T0_MS + 999, 2.0)]


def test_prototype_stream(spark, feed, folder):
    for pair in prototype_pairs():
        feed(pair)
    feed((60, json.dumps({"connection_start": 1, "connection_end": 2, "success": True,
                          "transaction_type": "read"})))
    results = streaming.stream_sql_windowed_latency(feed.stream())
    query = (results.writeStream.format("memory").queryName("prototype").outputMode("append")
             .option("checkpointLocation", folder("progress")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = sorted((r.timestamp, r.average_latency, r.failure_percent)
                 for r in spark.table("prototype").collect())
    assert got == [(1582617604999, 6.0, 0.5), (1582617609999, 4.0, 0.0)]


def test_two_outputs_of_one_stream(spark, feed, folder):
    feed((0, message()), (1, "broken"), (1, "[]"))
    feed((2, message()), (3, json.dumps([{"job_id": "x"}, {"job_id": "y", "operation": "read"}])))
    streaming.start_parse_with_quarantine(feed.stream(), folder("split"), folder("progress")).awaitTermination()
    split = streaming.read_split(spark, folder("split"))
    accepted, rejected = parse.accepted_records(split), parse.rejected_payloads(split)
    assert sorted(r.job_id for r in accepted.collect()) == ["j", "j", "y"]
    assert sorted((r.rejected, r.payload) for r in rejected.collect()) == [
        ("message", "broken"), ("record", '{"job_id":"x"}')]
    counts = {r.batch: (r.messages, r.elements, r.accepted, r.record, r.message)
              for r in streaming.read_split_counts(spark, folder("split")).collect()}
    assert counts == {0: (3, 2, 1, 0, 1), 1: (2, 3, 2, 1, 0)}


def test_a_split_batch_that_runs_again_replaces_its_own(spark, feed, folder):
    feed((0, message()), (1, "broken"))
    for progress in ("first", "second"):
        streaming.start_parse_with_quarantine(
            feed.stream(), folder("split"), folder(progress)).awaitTermination()
    assert streaming.read_split(spark, folder("split")).count() == 2
    assert streaming.read_split_counts(spark, folder("split")).count() == 1


def test_a_batch_whose_elements_do_not_add_up_fails(spark, feed, folder, monkeypatch):
    feed((0, message()))
    whole = parse.split_messages
    monkeypatch.setattr(streaming.parse, "split_messages",
                        lambda m, read, kept: whole(m, read).where("payload = 'other'").observe(
                            kept, *[F.count(F.when(F.col("outcome") == o, 1)).alias(o)
                                    for o in ("accepted", "record", "message")]))
    query = streaming.start_parse_with_quarantine(feed.stream(), folder("split"), folder("progress"))
    with pytest.raises(Exception, match="ElementsLost"):
        query.awaitTermination()


def test_sweep_uses_the_time_of_its_tick(spark, make_messages, folder):
    resources = spark.createDataFrame(
        [("a", 1, 1, T0_MS / 1000 + 5, "leased", "10.0.0.1", None), ("b", 1, 1, T0_MS / 1000 + 50, "leased", "10.0.0.2", None),
         ("c", 1, 1, 0.0, "ready", "10.0.0.3", None)], schemas.RESOURCE)
    for second in (0, 10, 60):
        make_messages((second, "tick")).coalesce(1).write.mode("append").parquet(folder("ticks"))
        ticks = sources.stream_messages(spark, folder("ticks")).select(
            F.col("publish_time").alias("timestamp"))
        streaming.start_lease_sweep(ticks, lambda s: resources, folder("sweeps"),
                                    folder("progress"), interval=None).awaitTermination()
    got = {(r.sweep, r.resource_id) for r in spark.read.parquet(folder("sweeps")).collect()}
    assert got == {(1, "a"), (2, "a"), (2, "b")}
    assert pool.expired_leases(resources, T0_MS / 1000).count() == 0


def test_heartbeats_are_messages_without_records(spark):
    beat = streaming.heartbeat(spark)
    assert beat.isStreaming and beat.columns == schemas.MESSAGE.fieldNames()


def test_heartbeat_closes_the_newest_window(spark, feed, folder):
    feed((0, message()))
    series = streaming.stream_windowed_latency_failure(
        feed.stream().unionByName(streaming.heartbeat(spark)))
    query = streaming.start_series_sink(series, folder("series"), folder("progress"), "200 milliseconds")
    try:
        for _ in range(120):
            query.awaitTermination(0.5)
            # Only what a batch has committed counts: stopping cuts off a batch under way.
            if os.path.isdir(folder("series") + "/_spark_metadata") \
                    and not sources.read_series(spark, folder("series")).isEmpty():
                break
    finally:
        query.stop()
    assert [r.timestamp for r in sources.read_series(spark, folder("series")).collect()] == [T0_MS + 999]


LOG = "resource_id string, seq bigint, status string, expiry double"


@pytest.fixture
def lease(spark, folder):
    """Send changes of resources a, b and c as one batch; the state after it."""
    resources = spark.createDataFrame(
        [(r, 1, 1, 5.0, "ready", "10.0.0.1", None) for r in "abc"], schemas.RESOURCE)

    def send(*changes):
        spark.createDataFrame(changes, LOG).coalesce(1).write.mode("append").parquet(folder("log"))
        log = spark.readStream.schema(LOG).parquet(folder("log"))
        streaming.start_resource_state(resources, log, folder("state"), folder("progress")).awaitTermination()
        rows = streaming.read_resource_state(spark, folder("state")).collect()
        assert len(rows) == 3
        return {r.resource_id: (r.status, r.expiry) for r in rows}

    return send


def test_a_late_change_cannot_undo_a_later_one(lease):
    assert lease(("a", 1, "leased", 100.0), ("a", 4, "cleaning", None), ("x", 1, "down", 1.0)) == {
        "a": ("cleaning", 100.0), "b": ("ready", 5.0), "c": ("ready", 5.0)}
    late = lease(("a", 3, "leased", 300.0), ("a", 2, "down", 7.0), ("b", 1, "leased", 200.0))
    assert late == {"a": ("cleaning", 300.0), "b": ("leased", 200.0), "c": ("ready", 5.0)}
    again = lease(("a", 1, "leased", 100.0), ("b", 1, "leased", 200.0), ("c", None, "down", None))
    assert again == {"a": ("cleaning", 300.0), "b": ("leased", 200.0), "c": ("down", 5.0)}
    last = lease(("a", 9, "ready", None), ("c", 0, "ready", None))
    assert last == {"a": ("ready", 300.0), "b": ("leased", 200.0), "c": ("ready", 5.0)}


def test_streamed_state_is_the_batch_state(spark, lease):
    changes = [("abc"[i % 3], (i * 7) % 31, ["leased", "cleaning", "ready", "down"][i % 4], float(i)) for i in range(31)]
    for part in (changes[20:], changes[:10], changes[10:20], changes[5:25]):
        got = lease(*part)
    resources = spark.createDataFrame(
        [(r, 1, 1, 5.0, "ready", "10.0.0.1", None) for r in "abc"], schemas.RESOURCE)
    batch = pool.resource_state_after(resources, spark.createDataFrame(changes, LOG)).collect()
    assert got == {r.resource_id: (r.status, r.expiry) for r in batch}


def batched(spark, feed, folder, **options):
    messages = streaming.stream_batched_messages(feed.stream(), **options)
    streaming.start_message_sink(messages, folder("batched"), folder("batching")).awaitTermination()
    return sorted((r.publish_time.timestamp() * 1000 - T0_MS, r.workload_id, len(json.loads(r.data)))
                  for r in spark.read.parquet(folder("batched")).collect())


def test_intervals_are_batched_once_they_are_closed(spark, feed, folder):
    feed((0, message("a")), (0.2, message("b")), (0.7, message("c")))
    feed((0.3, message("late by nothing")), (2, message("d")))
    # The watermark is at 2 s: the intervals before it are closed, the last is open.
    assert batched(spark, feed, folder) == [(0, "w", 3), (500, "w", 1)]
    feed((0.1, message("too late")), (60, "[]"))
    feed(CLOSING)
    assert batched(spark, feed, folder) == [(0, "w", 3), (500, "w", 1), (2000, "w", 1)]
    assert batched(spark, feed, folder) == [(0, "w", 3), (500, "w", 1), (2000, "w", 1)]


def test_a_crowded_interval_is_dealt_to_parts(spark, feed, folder):
    feed(*[(i / 1000, message(f"job-{i}")) for i in range(200)], CLOSING)
    feed(CLOSING)
    sizes = [n for _, _, n in batched(spark, feed, folder, parts=4)]
    assert len(sizes) == 4 and sum(sizes) == 200 and max(sizes) < 90


def test_open_windows_are_in_the_state_and_closed_ones_gone(spark, feed, folder):
    feed((0, message(latency=1.0)), (0.5, message(ok=False)), (10, message("k", latency=2.0, op="write")))
    series = streaming.stream_windowed_latency_failure(feed.stream(), "5 seconds")

    def held():
        streaming.start_series_sink(series, folder("series"), folder("progress")).awaitTermination()
        return sorted((r.job_id, r.query_action, r.latency_sum, r.successes, r.total)
                      for r in streaming.read_open_windows(spark, folder("progress")).collect())

    assert held() == [("k", "write", 2.0, 1, 1)]
    feed((11, message("k", latency=4.0, op="write")), (12, message("l", ok=False)))
    assert held() == [("k", "write", 6.0, 2, 2), ("l", "read", None, 0, 1)]
    feed(CLOSING)
    assert held() == []


def test_streams_set_up_their_state_whatever_the_session_says(spark, feed, folder):
    from loadpulse.session import STATE_DEFAULTS
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.unset(provider)
    try:
        feed((0, message()))
        series = streaming.stream_windowed_latency_failure(feed.stream())
        streaming.start_series_sink(series, folder("series"), folder("progress")).awaitTermination()
        assert spark.conf.get(provider, None) is None
        with open(folder("progress") + "/offsets/0") as log:
            assert STATE_DEFAULTS[provider] in log.read()
    finally:
        spark.conf.set(provider, before)
