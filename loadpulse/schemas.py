"""Row types of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

# One message of the topic.  Its event time is the time it was published.
MESSAGE = T.StructType([
    T.StructField("publish_time", T.TimestampType()),
    T.StructField("data", T.StringType()),
])

# One timed transaction.  The four times are seconds of a monotonic clock: only
# differences mean anything, and they need double precision (a single float has
# a resolution of 0.125 s at the size such clocks reach).
TRANSACTION = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("workload_id", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("connection_start", T.DoubleType()),
    T.StructField("connection_end", T.DoubleType()),
    T.StructField("transaction_start", T.DoubleType()),
    T.StructField("transaction_end", T.DoubleType()),
])

# What became of an element of a message: a record, or a payload that was rejected.
SPLIT = T.StructType([
    T.StructField("publish_time", T.TimestampType()),
    T.StructField("record", TRANSACTION),
    T.StructField("payload", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("outcome", T.StringType()),
])

# The record of the SQL prototype: one JSON object per message.
PROTOTYPE_TRANSACTION = T.StructType([
    T.StructField("connection_start", T.IntegerType()),
    T.StructField("transaction_start", T.IntegerType()),
    T.StructField("transaction_end", T.IntegerType()),
    T.StructField("connection_end", T.IntegerType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("database_type", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("load_id", T.IntegerType()),
])

# One window result; a job's rows together are its series.  ``timestamp`` is
# epoch milliseconds, ``average_latency`` seconds.
SERIES = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("query_action", T.StringType()),
    T.StructField("average_latency", T.DoubleType()),
    T.StructField("failure_percent", T.FloatType()),
    T.StructField("timestamp", T.LongType()),
])

JOB = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("db_type", T.IntegerType()),
    T.StructField("db_size", T.IntegerType()),
    T.StructField("read_pattern", T.IntegerType()),
    T.StructField("write_pattern", T.IntegerType()),
    T.StructField("read_intensity", T.IntegerType()),
    T.StructField("write_intensity", T.IntegerType()),
])

RESOURCE = T.StructType([
    T.StructField("resource_id", T.StringType()),
    T.StructField("database_type", T.IntegerType()),
    T.StructField("database_size", T.IntegerType()),
    T.StructField("expiry", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("connection_string", T.StringType()),
    T.StructField("replica_ip", T.StringType()),
])

PICTURE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("lineColor", T.IntegerType()),
    T.StructField("fillColor", T.IntegerType()),
    T.StructField("shape1", T.IntegerType()),
    T.StructField("shape2", T.IntegerType()),
    T.StructField("artist", T.IntegerType()),
])
