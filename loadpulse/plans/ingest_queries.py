"""Sources, parsing and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .. import schemas, sources
from ..operators import ids, parse
from ..session import new_location
from ..sources import stores
from ..streaming import jobs as streaming
from .registry import query
from .views import Tables

_RECORD = ("job_id, workload_id, operation, success, connection_start, connection_end, "
           "transaction_start, transaction_end")
_TXN_CHECK = f"select {_RECORD}, epoch_us(publish_time) as publish_us from txn"
_PACKED_CHECK = f"select {_RECORD}, epoch_us(publish_time) as publish_us from txn_packed"


def _with_micros(records):
    return records.select(*schemas.TRANSACTION.fieldNames(),
                          F.unix_micros("publish_time").alias("publish_us"))


def stream_of_messages(t: Tables):
    """The given events arriving as messages of one record each."""
    return sources.messages_from_records(t.view("txn", events=t.given_stream("events")))


@query("txn_stream_source", check=_TXN_CHECK)
def txn_stream_source(t: Tables):
    path = new_location(t.spark, "records")
    streaming.start_parse_with_quarantine(
        stream_of_messages(t), path, new_location(t.spark, "progress")).awaitTermination()
    return _with_micros(parse.accepted_records(streaming.read_split(t.spark, path)))


@query("txn_batch_source", check="""
    select cast(epoch_us(max(publish_time)) as bigint) as publish_us,
           count(*) as records, count(*) filter (not success) as failures,
           min(connection_start) as first_start, max(connection_end) as last_end,
           round(sum(transaction_end - transaction_start), 6) as busy
    from txn_packed group by message_id
""")
def txn_batch_source(t: Tables):
    path = new_location(t.spark, "messages")
    t.packed_messages.write.parquet(path)
    records = parse.parse_messages(sources.read_messages(t.spark, path))
    return records.groupBy(F.unix_micros("publish_time").alias("publish_us")).agg(
        F.count("*").alias("records"),
        F.count(F.when(~F.col("success"), 1)).alias("failures"),
        F.min("connection_start").alias("first_start"), F.max("connection_end").alias("last_end"),
        F.round(F.sum(fn.latency()), 6).alias("busy"))


@query("parse_txn_array", check=_PACKED_CHECK)
def parse_txn_array(t: Tables):
    return _with_micros(parse.parse_messages(t.packed_messages))


# What happens to a message's text on the way, by the remainder of its event's id.
DAMAGE_KINDS = 13
_DAMAGED_WHOLE, _DAMAGED_RECORD = (0, 1, 3, 4, 6, 7, 10, 11, 12), (2, 5)
# Of these kinds the record itself is usable.
SOUND_RECORD = (5, 8, 9)
OUTCOME_CHECK = f"""case when event_id % {DAMAGE_KINDS} in {_DAMAGED_WHOLE} then 'message'
                         when event_id % {DAMAGE_KINDS} in {_DAMAGED_RECORD} then 'record' end"""


def damaged_messages(t: Tables, events):
    """Messages of one record each, eleven of thirteen kinds damaged on the way.

    A text is cut short, is a bare object, has a number for ``success``, has a second
    array or other text behind it, has an element that is no object beside the record,
    is empty, or null, or brings brackets that could pass for those of a reader.
    """
    txn = t.view("txn", events=events)
    record = F.struct(*schemas.TRANSACTION.fieldNames())
    whole = txn.select("publish_time", F.pmod("event_id", F.lit(DAMAGE_KINDS)).alias("kind"),
                       F.to_json(F.array(record)).alias("data"))
    inner = F.substr("data", F.lit(2), F.length("data") - 2)
    data = (
        F.when(F.col("kind") == 0, F.substr("data", F.lit(1), F.length("data") - 3))
        .when(F.col("kind") == 1, inner)
        .when(F.col("kind") == 2, F.regexp_replace("data", '"success":(true|false)', '"success":7'))
        .when(F.col("kind") == 3, F.concat("data", "data"))
        .when(F.col("kind") == 4, F.concat("data", F.lit(" x ]")))
        .when(F.col("kind") == 5, F.concat(F.lit("["), inner, F.lit(",5]")))
        .when(F.col("kind") == 6, F.lit(""))
        .when(F.col("kind") == 7, F.lit(None).cast("string"))
        .when(F.col("kind") == 10, F.concat("data", F.lit(","), "data", F.lit("] "), "data"))
        .when(F.col("kind") == 11, F.concat("data", F.lit(",[]] x")))
        .when(F.col("kind") == 12, F.concat("data", F.lit(",null] "), inner))
        .otherwise(F.col("data"))
    )
    return whole.select("publish_time", data.alias("data"))


@query("parse_txn_quarantine", check=f"""
    select epoch_us(ts) as publish_us, {OUTCOME_CHECK} as rejected
    from events where {OUTCOME_CHECK} is not null
""")
def parse_txn_quarantine(t: Tables):
    return parse.quarantine(damaged_messages(t, t.given("events"))).select(
        F.unix_micros("publish_time").alias("publish_us"), "rejected")


@query("parse_txn_damaged", check=f"""
    select {_RECORD}, epoch_us(publish_time) as publish_us from txn
    where event_id % {DAMAGE_KINDS} in {SOUND_RECORD}
""")
def parse_txn_damaged(t: Tables):
    return _with_micros(parse.parse_messages(damaged_messages(t, t.given("events"))))


# Objects: cut short, with text or other objects behind them, in an array, or as they are.
@query("parse_txn_object_damaged", check="""
    select case when event_id % 7 < 5 then 'rejected' else 'accepted' end as outcome,
           case when event_id % 7 >= 5 then load_id end as load_id,
           epoch_us(publish_time) as publish_us
    from proto
""")
def parse_txn_object_damaged(t: Tables):
    proto, data = t.view("proto"), F.col("data")
    kind = F.pmod("event_id", F.lit(7))
    whole = proto.select("publish_time", kind.alias("kind"), F.to_json(
        F.struct(*schemas.PROTOTYPE_TRANSACTION.fieldNames())).alias("data"))
    messages = whole.select("publish_time", (
        F.when(F.col("kind") == 0, F.substr(data, F.lit(1), F.length(data) - 2))
        .when(F.col("kind") == 1, F.concat(data, F.lit(",{}] x")))
        .when(F.col("kind") == 2, F.concat(data, F.lit(","), data, F.lit("] "), data))
        .when(F.col("kind") == 3, F.concat(F.lit("["), data, F.lit("]")))
        .when(F.col("kind") == 4, F.concat(data, data)).otherwise(data)).alias("data"))
    at = F.unix_micros("publish_time").alias("publish_us")
    good = parse.parse_objects(messages, strict=False).select(
        F.lit("accepted").alias("outcome"), "load_id", at)
    bad = parse.quarantine_objects(messages).select(
        F.lit("rejected").alias("outcome"), F.lit(None).cast("int").alias("load_id"), at)
    return good.unionByName(bad)


@query("parse_txn_object", check="""
    select epoch_us(publish_time) as publish_us, connection_start, transaction_start,
           transaction_end, connection_end, success, database_type, transaction_type, load_id
    from proto
""")
def parse_txn_object(t: Tables):
    parsed = parse.parse_objects(t.object_messages())
    return parsed.select(F.unix_micros("publish_time").alias("publish_us"),
                         *schemas.PROTOTYPE_TRANSACTION.fieldNames())


@query("latency_projection", check="""
    select job_id, operation, success, round(transaction_end - transaction_start, 9) as latency,
           cast(connection_end as float) - cast(connection_start as float) as prototype_latency
    from txn
""")
def latency_projection(t: Tables):
    return t.records.select(
        "job_id", "operation", "success", F.round(fn.latency(), 9).alias("latency"),
        fn.prototype_latency().alias("prototype_latency"))


@query("failure_flag", check="""
    select job_id, operation, success, case when success then 0 else 1 end as failed from txn
""")
def failure_flag(t: Tables):
    return t.records.select("job_id", "operation", "success",
                            fn.failure_flag(F.col("success")).alias("failed"))


@query("compose_split_key", check="""
    select operation || '-' || job_id as key, operation as query_action, job_id,
           count(*) as records
    from txn group by operation, job_id
""")
def compose_split_key(t: Tables):
    keyed = parse.compose_key(t.records).groupBy("key").agg(F.count("*").alias("records"))
    return parse.decompose_key(keyed).select("key", "query_action", "job_id", "records")


@query("window_timestamp", check="""
    select epoch_us(publish_time) as publish_us,
           cast((epoch_us(publish_time) // 5000000 + 1) * 5000 - 1 as bigint) as "timestamp"
    from txn
""")
def window_timestamp(t: Tables):
    # A one-row-per-record look at the timestamps: the window is a projection here.
    windowed = t.records.select("publish_time", F.window("publish_time", "5 seconds").alias("w"))
    return windowed.select(F.unix_micros("publish_time").alias("publish_us"),
                           fn.window_timestamp(F.col("w")).alias("timestamp"))


@query("timing_fallback", check="""
    select job_id, success, connection_end,
           case when success then transaction_start else connection_end end as transaction_start,
           case when success then transaction_end else connection_end end as transaction_end
    from txn
""")
def timing_fallback(t: Tables):
    began = t.txn.withColumns({
        name: F.when(F.col("success"), F.col(name))
        for name in ("transaction_start", "transaction_end")
    })
    return fn.with_timing_fallback(began).select(
        "job_id", "success", "connection_end", "transaction_start", "transaction_end")


_BATCHED_CHECK = f"""
    select {_RECORD}, epoch_us(publish_time) // 500000 * 500 as interval_ms,
           count(*) over (partition by epoch_us(publish_time) // 500000, workload_id) as in_message
    from txn
"""


def _unpacked(messages):
    """Each record of batched messages, with its message's time and size."""
    items = F.from_json("data", f"array<struct<{schemas.TRANSACTION.simpleString()[7:-1]}>>")
    return (
        messages.select("publish_time", items.alias("items"))
        .select(F.unix_millis("publish_time").alias("interval_ms"),
                F.size("items").cast("bigint").alias("in_message"), F.inline("items"))
    )


@query("batch_messages", check=_BATCHED_CHECK)
def batch_messages(t: Tables):
    return _unpacked(parse.batch_messages(t.records))


# All events, and then a message a day behind them that closes every interval.
@query("stream_batched_messages", check=_BATCHED_CHECK)
def stream_batched_messages(t: Tables):
    topic, path, progress = [new_location(t.spark, n) for n in ("topic", "batched", "progress")]
    closing = t.given("events").agg(
        (F.max("ts").cast("timestamp") + F.expr("interval 1 day")).alias("publish_time")
    ).withColumn("data", F.lit("[]"))
    for messages in (t.messages, closing):
        messages.write.mode("append").parquet(topic)
        batched = streaming.stream_batched_messages(sources.stream_messages(t.spark, topic))
        streaming.start_message_sink(batched, path, progress).awaitTermination()
    return _unpacked(t.spark.read.parquet(path))


@query("job_list_source", check="""
    select job_id, row_number() over (order by seq) as place from job_list
""")
def job_list_source(t: Tables):
    path = new_location(t.spark, "job-list")
    t.job_list.orderBy("seq").select("job_id").write.text(path)
    listed = sources.read_job_list(t.spark, path)
    return ids.with_dense_ids(listed, ["seq"], "place", keep=["job_id"])


@query("jobs_scan", check="""
    select job_id, db_type, db_size, read_pattern, write_pattern, read_intensity,
           write_intensity from jobs
""")
def jobs_scan(t: Tables):
    return t.jobs.drop("seq")


@query("resources_scan", check="""
    select resource_id, database_type, database_size, expiry, status, connection_string, replica_ip
    from resources
""")
def resources_scan(t: Tables):
    path = new_location(t.spark, "resources")
    stores.append_partitioned(t.view("resources"), path, stores.RESOURCE_PARTITIONS)
    return sources.read_resources(t.spark, path)


@query("db_key", check="""
    select request_id, case db_type when 1 then 'sql' when 2 then 'sqlrep' when 3 then 'spanner' end
               || '-' || db_size || '-' || intensity as key,
           read_pattern || '-' || write_pattern as pattern
    from configs
""")
def db_key(t: Tables):
    return t.view("configs").select(
        "request_id",
        fn.db_key(F.col("db_type"), F.col("db_size"), F.col("intensity")).alias("key"),
        fn.pattern_key(F.col("read_pattern"), F.col("write_pattern")).alias("pattern"))


@query("parse_db_key", check="""
    select request_id, key,
           case when m then regexp_extract(key, '^([a-z]+)-', 1) end as prefix,
           case when m then case regexp_extract(key, '^([a-z]+)-', 1) when 'sql' then 1
                when 'sqlrep' then 2 when 'spanner' then 3 else -1 end end as db_type,
           case when m then cast(split_part(key, '-', 2) as int) end as db_size,
           case when m then cast(split_part(key, '-', 3) as int) end as intensity
    from (select *, regexp_full_match(key, '[a-z]+-[0-9]+-[0-9]+') as m from location_keys)
""")
def parse_db_key(t: Tables):
    return t.view("location_keys").select(
        "request_id", "key", fn.parse_db_key(F.col("key")).alias("p")
    ).select("request_id", "key", "p.*")


@query("code_labels", check="""
    select request_id,
           case db_type when 1 then 'cloud-sql' when 2 then 'cloud-sql-read-replica'
                when 3 then 'spanner' end as type_label,
           case db_size when 1 then '1x' when 2 then '2x' when 3 then '4x' end as size_label,
           'load-' || short || '1' as instance,
           case db_size when 1 then 1 when 2 then 2 when 3 then 3 else -1 end as size_of_instance,
           case when short = 'none' then null when db_type = 1 then 'p:r:load-' || short || '1'
                when db_type = 2 then 'p:r:load-' || short || '1-r'
                when db_type = 3 then 'load-' || short || '1' end as resource_name
    from (select *, case db_size when 1 then 'sm' when 2 then 'med' when 3 then 'lrg'
                    else 'none' end as short from configs)
""")
def code_labels(t: Tables):
    db_type, db_size = F.col("db_type"), F.col("db_size")
    short = fn.lookup(db_size, {1: "sm", 2: "med", 3: "lrg"}, F.lit("none"))
    instance = F.concat(F.lit("load-"), short, F.lit("1"))
    prefix = fn.parse_db_key(fn.db_key(db_type, db_size, F.col("intensity")))["prefix"]
    return t.view("configs").select(
        "request_id",
        fn.type_label(db_type).alias("type_label"),
        fn.size_label(db_size).alias("size_label"),
        instance.alias("instance"),
        fn.size_from_name(instance).alias("size_of_instance"),
        fn.resource_name(prefix, db_size, "p", "r", "load").alias("resource_name"),
    )


@query("intensity_multiplier", check="""
    select request_id, intensity,
           case intensity when 2 then 6 when 3 then 12 else intensity end as pods
    from configs
""")
def intensity_multiplier(t: Tables):
    return t.view("configs").select(
        "request_id", "intensity", fn.intensity_multiplier(F.col("intensity")).alias("pods"))
