"""The operators' input tables as views over the given tables.

``SHARED`` holds one text per view that both engines run: Spark for the queries,
and, after a few word substitutions, the SQL engine that checks them.
``CHECK_ONLY`` are results the checks build on, written in the checking
engine's SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas, sources
from ..operators import ids, parse, promote, quality, windows, workload
from ..session import new_location
from ..sources import stores
from ..sources.tables import values_text

NOW = 1_700_005_000
SERIES_WIDTH = "6 hours"
SERIES_WIDTH_US = 6 * 3600 * 1_000_000
STRICT_Z = 4.5

SHARED = {
    # Transactions: 12 jobs, error events are the failures, latency is value in ms.
    "txn": """
        select event_id,
               concat('job-', cast(user_id % 12 as string)) as job_id,
               concat('w-', cast(event_id % 7 as string)) as workload_id,
               case when cast(get_json_object(props, '$.k') as int) % 3 = 0
                    then 'write' else 'read' end as operation,
               event_type <> 'error' as success,
               cast(event_id as double) as connection_start,
               cast(event_id as double) + value / 1000 + 0.01D as connection_end,
               cast(event_id as double) as transaction_start,
               cast(event_id as double) + value / 1000 as transaction_end,
               cast(ts as timestamp) as publish_time
        from {events}
    """,
    # The SQL prototype's records, with whole-number times.
    "proto": """
        select event_id,
               cast(event_id % 1000000 as int) as connection_start,
               cast(event_id % 1000000 as int) + 1 as transaction_start,
               cast(event_id % 1000000 as int) + 1 + cast(floor(value) as int) as transaction_end,
               cast(event_id % 1000000 as int) + 2 + cast(floor(value) as int) as connection_end,
               event_type <> 'error' as success,
               'database' as database_type,
               case when cast(get_json_object(props, '$.k') as int) % 3 = 0
                    then 'write' else 'read' end as transaction_type,
               cast(user_id as int) as load_id,
               cast(ts as timestamp) as publish_time
        from {events}
    """,
    # One row per job.  job-10 lacks its size; job-0 and job-11 share a location and
    # job-11 is listed first; job-3 is not listed (no seq).
    "jobs": """
        select concat('job-', cast(i as string)) as job_id,
               cast(case when i = 11 then 1 else i % 3 + 1 end as int) as db_type,
               cast(case when i = 10 then null when i = 11 then 1
                         else (i div 3) % 3 + 1 end as int) as db_size,
               cast(case when i = 11 then 1 else i % 3 + 1 end as int) as read_pattern,
               cast(case when i = 11 then 1 else (i div 4) % 3 + 1 end as int) as write_pattern,
               cast(case when i = 11 then 1 else i % 2 + 1 end as int) as read_intensity,
               cast((i + 1) % 3 + 1 as int) as write_intensity,
               cast(case when i = 3 then null else 11 - i end as int) as seq
        from (select distinct user_id % 12 as i from {events}) u
    """,
    "job_list": """
        select job_id, seq from {jobs} where seq is not null
    """,
    "picture_rows": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               l_shipdate,
               cast(l_orderkey % 6 + 1 as int) as lineColor,
               cast(l_partkey % 6 + 1 as int) as fillColor,
               cast(l_suppkey % 13 + 1 as int) as shape1,
               cast(l_linenumber % 13 + 1 as int) as shape2,
               cast(l_partkey % 22 + 1 as int) as artist,
               concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string),
                         cast(l_partkey as string), cast(l_suppkey as string),
                         cast(cast(round(l_quantity * 100) as bigint) as string),
                         cast(cast(round(l_extendedprice * 100) as bigint) as string),
                         cast(cast(l_shipdate as date) as string)) as row_key
        from {lineitem}
    """,
    "picture_changes": """
        select cast(o_custkey as bigint) as id, o_orderkey as seq,
               case o_orderkey % 5 when 0 then 'lineColor' when 1 then 'fillColor'
                    when 2 then 'shape1' when 3 then 'shape2' else 'artist' end as col,
               cast(case when o_orderkey % 5 < 2 then o_custkey % 6
                         when o_orderkey % 5 < 4 then o_custkey % 13
                         else o_custkey % 22 end + 1 as int) as val
        from {orders}
    """,
    "picture_inserts": """
        select o_orderkey,
               cast(o_custkey % 6 + 1 as int) as lineColor,
               cast(o_orderkey % 6 + 1 as int) as fillColor,
               cast(o_custkey % 13 + 1 as int) as shape1,
               cast(o_orderkey % 13 + 1 as int) as shape2,
               cast(o_custkey % 22 + 1 as int) as artist
        from {orders}
    """,
    "write_kinds": """
        select 'insert' as kind from {lineitem}
        union all
        select case when col in ('lineColor', 'fillColor') then 'color'
                    when col in ('shape1', 'shape2') then 'shape' else 'artist' end as kind
        from {picture_changes}
    """,
    "resources": """
        select concat('res-', cast(s_suppkey as string)) as resource_id,
               cast(s_suppkey % 3 + 1 as int) as database_type,
               cast((s_suppkey div 3) % 3 + 1 as int) as database_size,
               cast(1700000000 as double) + s_acctbal as expiry,
               case s_nationkey % 5 when 0 then 'ready' when 1 then 'ready' when 2 then 'leased'
                    when 3 then 'cleaning' else 'down' end as status,
               case when s_suppkey % 3 = 2 then concat('res-', cast(s_suppkey as string))
                    else concat('10.0.', cast(s_suppkey % 250 as string), '.1') end
                   as connection_string,
               case when s_suppkey % 3 = 1
                    then concat('10.1.', cast(s_suppkey % 250 as string), '.1') end as replica_ip
        from {supplier}
    """,
    "lease_log": """
        select concat('res-', cast(user_id as string)) as resource_id, event_id as seq,
               case event_type when 'view' then 'leased' when 'click' then 'cleaning'
                    when 'error' then 'down' else 'ready' end as status,
               cast(1700000000 as double) + event_id + value as expiry
        from {events}
    """,
    # Two registration requests per id; ids of existing resources conflict.
    "registrations": """
        select c_custkey as seq,
               concat('res-', cast(c_custkey div 2 as string)) as resource_id,
               cast((c_custkey div 2) % 3 + 1 as int) as database_type,
               cast((c_custkey div 6) % 3 + 1 as int) as database_size,
               concat('10.2.', cast(c_custkey % 250 as string), '.1') as connection_string,
               case when (c_custkey div 2) % 3 = 1 then '10.3.0.1' end as replica_ip
        from {customer}
    """,
    "registry": """
        select c_custkey as request_id,
               cast(case when c_custkey % 17 = 0 then null else c_custkey % 5 end as int)
                   as database_type,
               cast(case when c_custkey % 19 = 0 then null else (c_custkey div 5) % 4 end as int)
                   as database_size,
               case when c_custkey % 23 = 0 then null when c_custkey % 29 = 0 then ''
                    when c_nationkey % 8 = 0 then concat('Res_', cast(c_custkey as string))
                    when c_nationkey % 8 = 4 then concat('res ', cast(c_custkey as string))
                    when c_custkey % 5 = 2 then concat('res:', cast(c_custkey as string))
                    else concat('res-', cast(c_custkey as string)) end as resource_id,
               case c_custkey % 9 when 0 then null when 1 then '10.0.0.7' when 2 then 'db.internal'
                    when 3 then '10.0.0.8/db' when 4 then '.7' when 5 then ''
                    else concat('res-', cast(c_custkey as string)) end as connection_string,
               case when c_custkey % 2 = 0 then '10.0.0.9' else null end as replica_ip
        from {customer}
    """,
    "run_requests": """
        select c_custkey as request_id,
               case when c_custkey % 47 = 0 then 'cached' when c_nationkey % 3 = 0 then 'fail'
                    when c_nationkey % 3 = 1 then 'run' else 'single' end as mode,
               case when c_mktsegment = 'BUILDING' and c_custkey % 4 = 0 then null
                    else cast(c_custkey % 3 + 1 as string) end as read_pattern,
               case c_custkey % 19 when 0 then null when 1 then 'steady'
                    else cast((c_custkey div 3) % 3 + 1 as string) end as write_pattern,
               case when c_mktsegment = 'MACHINERY' and c_custkey % 4 = 1 then 'high'
                    else cast((c_custkey div 9) % 3 + 1 as string) end as intensity,
               case c_custkey % 23 when 0 then null when 1 then 'sql'
                    else cast(c_custkey % 5 as string) end as db_type,
               case c_custkey % 31 when 0 then null when 1 then 'x1'
                    else cast((c_custkey div 5) % 5 as string) end as db_size,
               case c_custkey % 37 when 0 then null when 1 then 'big'
                    else cast((c_custkey div 2) % 3 + 1 as string) end as sql_size,
               case c_custkey % 41 when 0 then null when 1 then 'big'
                    else cast((c_custkey div 4) % 3 + 1 as string) end as sql_rep_size,
               case c_custkey % 43 when 0 then null when 1 then 'big'
                    else cast((c_custkey div 8) % 3 + 1 as string) end as spanner_size
        from {customer}
    """,
    "configs": """
        select c_custkey as request_id,
               cast(c_custkey % 5 as int) as db_type,
               cast((c_custkey div 5) % 4 as int) as db_size,
               cast((c_custkey div 20) % 6 as int) as intensity,
               cast((c_custkey div 7) % 3 + 1 as int) as read_pattern,
               cast((c_custkey div 11) % 3 + 1 as int) as write_pattern
        from {customer}
    """,
    "location_keys": """
        select request_id,
               concat(case db_type when 1 then 'sql' when 2 then 'sqlrep' when 3 then 'spanner'
                           when 4 then 'other' else 'Sql' end,
                      '-', cast(db_size as string), '-', cast(intensity as string)) as key
        from {configs}
    """,
}

_PICTURE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_shipdate"]


def series_check(records: str, width_us: int, time: str = "publish_time") -> str:
    """The series of ``records`` in the checking engine's SQL."""
    slot = f"epoch_us({time}) // {width_us}"
    return f"""
        select job_id, operation as query_action,
               case when count(*) filter (success) = 0 then 'nan'::double
                    else sum(transaction_end - transaction_start) filter (success)
                         / count(*) filter (success) end as average_latency,
               cast(cast(cast(count(*) filter (not success) as float) / cast(count(*) as float)
                    as float) * cast(100 as float) as float) as failure_percent,
               cast(({slot} + 1) * {width_us} // 1000 - 1 as bigint) as "timestamp"
        from {records} group by job_id, operation, {slot}
    """


def verdict_check(z_limit: float, ignore_nan: bool) -> str:
    """Verdicts of the listed jobs in the checking engine's SQL."""
    judged = ("case when isnan(average_latency) then null else average_latency end"
              if ignore_nan else "average_latency")
    return f"""
        select l.job_id, l.key, l.pattern, l.seq,
               coalesce(s.row_count, 0) as row_count, coalesce(s.span_ms, 0) as span_ms,
               coalesce(s.row_count, 0) >= {K.MINIMUM_ROWS} as enough_rows,
               coalesce(s.span_ms, 0) >= {K.MINIMUM_SPAN_MS} as long_enough,
               coalesce(s.outliers, 0) = 0 as no_outliers,
               true as all_timed,
               coalesce(s.row_count, 0) >= {K.MINIMUM_ROWS}
               and coalesce(s.span_ms, 0) >= {K.MINIMUM_SPAN_MS}
               and coalesce(s.outliers, 0) = 0 as passed
        from (select j.*, jl.seq as listed from located_jobs j
              join job_list jl on j.job_id = jl.job_id) l
        left join (
            select job_id, count(*) as row_count, max("timestamp") - min("timestamp") as span_ms,
                   count(*) filter (not isnan(z) and abs(z) > {z_limit}) as outliers
            from (select job_id, "timestamp",
                         case when d = 0 then 'nan'::double else (y - m) / d end as z
                  from (select job_id, "timestamp", {judged} as y,
                               avg({judged}) over (partition by job_id) as m,
                               stddev_pop({judged}) over (partition by job_id) as d
                        from series))
            group by job_id
        ) s on l.job_id = s.job_id
    """


def _first_passing(verdicts: str) -> str:
    return f"""
        select key, pattern, arg_min(job_id, seq) as job_id
        from {verdicts} where passed group by key, pattern
    """


CHECK_ONLY = {
    "txn_packed": """
        select * exclude (publish_time),
               max(publish_time) over (partition by event_id // 20) as publish_time,
               event_id // 20 as message_id
        from txn
    """,
    "colors": "select * from (values %s) t(id, color, hex)" % values_text(K.COLORS),
    "shapes": "select * from (values %s) t(id, shape, sides)" % values_text(K.SHAPES),
    "artists": "select * from (values %s) t(id, artist, age)" % values_text(K.ARTISTS),
    "pictures": """
        select cast(row_number() over (order by %s) as bigint) as id,
               lineColor, fillColor, shape1, shape2, artist
        from picture_rows
    """ % ", ".join(_PICTURE_ORDER),
    "series": series_check("txn", SERIES_WIDTH_US),
    "located_jobs": """
        select *, case db_type when 1 then 'sql' when 2 then 'sqlrep' else 'spanner' end
                  || '-' || db_size || '-' || read_intensity as key,
               read_pattern || '-' || write_pattern as pattern
        from jobs where db_size is not null
    """,
    "verdicts": verdict_check(K.Z_SCORE_LIMIT, ignore_nan=False),
    "strict_verdicts": verdict_check(STRICT_Z, ignore_nan=True),
    "strict_winners": _first_passing("strict_verdicts"),
    "winners": """
        select w.* from (%s) w
        where not exists (select 1 from strict_winners s
                          where s.key = w.key and s.pattern = w.pattern)
    """ % _first_passing("verdicts"),
    "staged": """
        select s.*, w.key, w.pattern from series s join strict_winners w on s.job_id = w.job_id
        union all
        select s.*, w.key, w.pattern from series s join winners w on s.job_id = w.job_id
    """,
}

_TO_CHECK = [(" div ", " // "), (" as string", " as varchar"), ("0.01D", "0.01::double"),
             ("get_json_object(", "json_extract_string(")]


def _check_text(name: str) -> str:
    if name in CHECK_ONLY:
        return CHECK_ONLY[name]
    text = SHARED[name]
    for spark_word, check_word in _TO_CHECK:
        text = text.replace(spark_word, check_word)
    return re.sub(r"\{(\w+)\}", r"\1", text)


def check_sql(body: str) -> str:
    """``body`` with a WITH clause for every view it needs, in order of need."""
    ordered: list[str] = []

    def add(text: str) -> None:
        for word in re.findall(r"\w+", text):
            if (word in SHARED or word in CHECK_ONLY) and word not in ordered:
                view = _check_text(word)
                if view != text:
                    add(view)
                    if word not in ordered:
                        ordered.append(word)

    add(body)
    if not ordered:
        return body
    views = ",\n".join(f"{name} as ({_check_text(name)})" for name in ordered)
    return f"with {views}\n{body}"


class Tables:
    """The given tables below a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def given_stream(self, name: str) -> DataFrame:
        """A given table, be it one file or a folder of files, as a stream of its files."""
        # A stream's path must be a folder unless it is a pattern; this pattern
        # matches the one name.
        pattern = f"{self.folder}/{name[:-1]}[{name[-1]}].parquet"
        return self.spark.readStream.schema(self.given(name).schema).option(
            "maxFilesPerTrigger", sources.FILES_PER_BATCH).parquet(pattern)

    def view(self, name: str, **inputs: DataFrame) -> DataFrame:
        """A shared view; ``inputs`` replace given tables or other views."""
        needed = re.findall(r"\{(\w+)\}", SHARED[name])
        frames = {
            n: inputs[n] if n in inputs else self.view(n) if n in SHARED else self.given(n)
            for n in needed
        }
        return self.spark.sql(SHARED[name], **frames)

    # --- messages and records ------------------------------------------------

    @cached_property
    def txn(self) -> DataFrame:
        return self.view("txn")

    @cached_property
    def messages(self) -> DataFrame:
        """One message per transaction, published when it happened."""
        return sources.messages_from_records(self.txn)

    @cached_property
    def packed_messages(self) -> DataFrame:
        """Twenty transactions per message, published at the last one's time."""
        record = F.struct(*schemas.TRANSACTION.fieldNames())
        return (
            self.txn.groupBy(F.expr("event_id div 20").alias("message_id"))
            .agg(F.max("publish_time").alias("publish_time"),
                 F.to_json(F.sort_array(F.collect_list(record))).alias("data"))
            .select("publish_time", "data")
        )

    def object_messages(self, proto: DataFrame | None = None) -> DataFrame:
        """One JSON object per message, as the SQL prototype takes them."""
        proto = self.view("proto") if proto is None else proto
        record = F.struct(*schemas.PROTOTYPE_TRANSACTION.fieldNames())
        return proto.select("publish_time", F.to_json(record).alias("data"))

    @cached_property
    def records(self) -> DataFrame:
        return parse.parse_messages(self.messages)

    @cached_property
    def series(self) -> DataFrame:
        """The series straight from the messages, for queries that read it once."""
        return windows.windowed_latency_failure(self.records, SERIES_WIDTH)

    @cached_property
    def stored_series(self) -> DataFrame:
        """The series as its job stores it, for queries that read it more than once."""
        path = new_location(self.spark, "series")
        stores.append_partitioned(self.series, path, stores.SERIES_PARTITIONS)
        return sources.read_series(self.spark, path)

    # --- jobs, verdicts, cache -----------------------------------------------

    @cached_property
    def jobs(self) -> DataFrame:
        return self.view("jobs")

    @cached_property
    def job_list(self) -> DataFrame:
        return self.view("job_list", jobs=self.jobs)

    def verdicts(self, series: DataFrame, **options) -> DataFrame:
        return quality.validate_series(series, self.jobs, self.job_list, **options)

    def strict_verdicts(self, series: DataFrame) -> DataFrame:
        return self.verdicts(series, z_limit=STRICT_Z, ignore_nan=True)

    def strict_locations(self, series: DataFrame) -> DataFrame:
        """Locations a promotion with the strict limit has filled, with their job."""
        return promote.first_wins(self.strict_verdicts(series))

    # --- pictures --------------------------------------------------------------

    @cached_property
    def picture_codes(self) -> DataFrame:
        """Pictures without ids, for queries that do not look at them."""
        return self.view("picture_rows").select(*workload.CHANGEABLE)

    @cached_property
    def pictures(self) -> DataFrame:
        numbered = ids.with_dense_ids(
            self.view("picture_rows"), _PICTURE_ORDER, keep=workload.CHANGEABLE)
        return numbered.select("id", *workload.CHANGEABLE)

    def dimension(self, name: str) -> DataFrame:
        return sources.dimension(self.spark, name)
