"""Windows, series checks, promotion and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas, sources
from ..operators import charts, parse, promote, quality, requests, windows
from ..session import new_location
from ..sources import occupancy, stores
from ..streaming import jobs as streaming
from .ingest_queries import (
    DAMAGE_KINDS,
    OUTCOME_CHECK,
    SOUND_RECORD,
    damaged_messages,
    stream_of_messages,
)
from .registry import query, rounded
from .views import CHECK_ONLY, SERIES_WIDTH, SERIES_WIDTH_US, STRICT_Z, Tables, series_check

_SERIES = ('job_id, query_action, round(average_latency, 9) as average_latency, '
           'failure_percent, "timestamp"')


# --- windows -------------------------------------------------------------------

@query("windowed_latency_failure",
       check=f"select {_SERIES} from ({series_check('txn', 1_000_000)})")
def windowed_latency_failure(t: Tables):
    return rounded(windows.windowed_latency_failure(t.records), "average_latency")


@query("windowed_latency_failure_6h", check=f"select {_SERIES} from series")
def windowed_latency_failure_6h(t: Tables):
    return rounded(t.series, "average_latency")


@query("windowed_latency_failure_packed",
       check=f"select {_SERIES} from ({series_check('txn_packed', 60_000_000)})")
def windowed_latency_failure_packed(t: Tables):
    records = parse.parse_messages(t.packed_messages)
    return rounded(windows.windowed_latency_failure(records, "1 minute"), "average_latency")


def _prototype_check(width_us: int) -> str:
    slot = f"epoch_us(publish_time) // {width_us}"
    return f"""
        select cast(avg(cast(connection_end as float) - cast(connection_start as float)) as float)
                   as average_latency,
               cast(cast(count(*) filter (not success) as double) / count(*) as float)
                   as failure_percent,
               transaction_type as query_action,
               cast(({slot} + 1) * {width_us} // 1000 - 1 as bigint) as "timestamp"
        from proto group by transaction_type, {slot}
    """


@query("sql_windowed_latency", check=_prototype_check(5_000_000))
def sql_windowed_latency(t: Tables):
    return windows.sql_windowed_latency(parse.parse_objects(t.object_messages()))


@query("sql_windowed_latency_6h", check=_prototype_check(21_600_000_000))
def sql_windowed_latency_6h(t: Tables):
    return windows.sql_windowed_latency(parse.parse_objects(t.object_messages()), SERIES_WIDTH)


@query("run_throughput", check="""
    select job_id, count(*) as transactions,
           round(max(transaction_end) - min(transaction_start), 6) as elapsed,
           round(count(*) / (max(transaction_end) - min(transaction_start)), 6) as per_second
    from txn group by job_id
""")
def run_throughput(t: Tables):
    return rounded(windows.run_throughput(t.records), "elapsed", "per_second", digits=6)


# --- stored series -----------------------------------------------------------

@query("series_scan", check=f"select {_SERIES} from series")
def series_scan(t: Tables):
    return rounded(t.stored_series, "average_latency")


def _staged(t: Tables) -> str:
    """A staging cache after a promotion with the strict limit and then the usual one."""
    series = t.stored_series
    path = new_location(t.spark, "staged")
    for verdicts in (t.strict_verdicts(series), t.verdicts(series)):
        promote.promote_to_stage(t.spark, series, verdicts, path)
    return path


_STAGED_CHECK = f"select key, pattern, {_SERIES} from staged"
_CACHE_COLUMNS = ["key", "pattern", "job_id", "query_action", "average_latency",
                  "failure_percent", "timestamp"]


@query("promote_to_stage", check=_STAGED_CHECK)
def promote_to_stage(t: Tables):
    staged = sources.read_cached_series(t.spark, _staged(t))
    return rounded(staged.select(*_CACHE_COLUMNS), "average_latency")


@query("cached_series_scan", check=f"""
    select key, pattern, count(*) as cached_rows, min("timestamp") as first_timestamp,
           max("timestamp") as last_timestamp, count(distinct job_id) as jobs
    from staged group by key, pattern
""")
def cached_series_scan(t: Tables):
    staged = sources.read_cached_series(t.spark, _staged(t))
    return staged.groupBy("key", "pattern").agg(
        F.count("*").alias("cached_rows"), F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"), F.count_distinct("job_id").alias("jobs"))


@query("promote_with_seed", check=f"select key, pattern, {_SERIES}, '7' as seed from staged")
def promote_with_seed(t: Tables):
    live = new_location(t.spark, "live")
    promote.promote_with_seed(t.spark, _staged(t), live, 7)
    return rounded(sources.read_cached_series(t.spark, live), "average_latency")


@query("copy_series", check=f"select {_SERIES}, '0' as seed from series")
def copy_series(t: Tables):
    source, target = new_location(t.spark, "series"), new_location(t.spark, "copied")
    stores.append_partitioned(t.series, source, stores.SERIES_PARTITIONS)
    sources.copy_series(t.spark, source, target, stores.SERIES_PARTITIONS, seed=0)
    copied = t.spark.read.parquet(target).withColumn("seed", F.col("seed").cast("string"))
    return rounded(copied, "average_latency")


# --- checks ------------------------------------------------------------------

@query("listed_jobs_only", check="""
    select job_id, db_type, read_pattern from jobs
    where job_id in (select job_id from job_list)
""")
def listed_jobs_only(t: Tables):
    return quality.listed_only(t.jobs, t.job_list).select("job_id", "db_type", "read_pattern")


@query("series_with_job", check=f"""
    select s.job_id, l.key, l.pattern, s.query_action,
           round(s.average_latency, 9) as average_latency, s.failure_percent, s."timestamp"
    from series s join located_jobs l on s.job_id = l.job_id
""")
def series_with_job(t: Tables):
    return rounded(quality.series_with_job(t.series, t.jobs), "average_latency")


@query("skipped_jobs", check="""
    select job_id from job_list where job_id not in (select job_id from located_jobs)
""")
def skipped_jobs(t: Tables):
    return quality.skipped_jobs(t.job_list, t.jobs).select("job_id")


@query("series_extent", check="""
    select job_id, count(*) as row_count, min("timestamp") as first_timestamp,
           max("timestamp") as last_timestamp, max("timestamp") - min("timestamp") as span_ms
    from series group by job_id
""")
def series_extent(t: Tables):
    return quality.series_extent(t.series)


def _z_check(ignore_nan: bool, series: str = "series") -> str:
    y = ("case when isnan(average_latency) then null else average_latency end"
         if ignore_nan else "average_latency")
    return f"""
        select job_id, query_action, "timestamp", round(m, 6) as mean, round(d, 6) as deviation,
               round(coalesce(case when d = 0 then 'nan'::double else (y - m) / d end,
                              'nan'::double), 6) as z
        from (select *, {y} as y, avg({y}) over (partition by job_id) as m,
                     stddev_pop({y}) over (partition by job_id) as d from {series})
    """


def _z_columns(df):
    return rounded(df.select("job_id", "query_action", "timestamp", "mean", "deviation", "z"),
                   "mean", "deviation", "z", digits=6)


@query("series_zscores", check=_z_check(False))
def series_zscores(t: Tables):
    return _z_columns(quality.series_zscores(t.stored_series))


@query("series_zscores_ignore_nan", check=_z_check(True))
def series_zscores_ignore_nan(t: Tables):
    return _z_columns(quality.series_zscores(t.stored_series, ignore_nan=True))


def _outlier_check(limit: float, ignore_nan: bool, series: str = "series") -> str:
    return f"select * from ({_z_check(ignore_nan, series)}) where not isnan(z) and abs(z) > {limit}"


@query("series_outliers", check=_outlier_check(K.Z_SCORE_LIMIT, False))
def series_outliers(t: Tables):
    return _z_columns(quality.series_outliers(t.stored_series))


@query("series_outliers_strict", check=_outlier_check(STRICT_Z, True))
def series_outliers_strict(t: Tables):
    return _z_columns(quality.series_outliers(t.stored_series, STRICT_Z, ignore_nan=True))


# No window of a short series can stand out by the usual limit.  Here the windows of all
# jobs are one long series per action, and those of some times are a thousand times slower.
_SLOWED_SLOTS, _SLOWED_BY = 97, 1000.0
_SLOT_WIDTH_MS = SERIES_WIDTH_US // 1000
CHECK_ONLY["slowed_series"] = f"""
    select query_action as job_id, query_action, "timestamp",
           average_latency * case when ("timestamp" + 1) // {_SLOT_WIDTH_MS} % {_SLOWED_SLOTS} = 0
                                  then {_SLOWED_BY}::double else 1::double end as average_latency
    from series where not isnan(average_latency)
"""


@query("series_outliers_slowed", check=_outlier_check(K.Z_SCORE_LIMIT, False, "slowed_series"))
def series_outliers_slowed(t: Tables):
    slot = F.expr(f"(timestamp + 1) div {_SLOT_WIDTH_MS}")
    slowed = t.stored_series.where(~F.isnan("average_latency")).withColumns({
        "job_id": F.col("query_action"),
        "average_latency": F.col("average_latency") * F.when(
            F.pmod(slot, F.lit(_SLOWED_SLOTS)) == 0, _SLOWED_BY).otherwise(1.0)})
    return _z_columns(quality.series_outliers(slowed))


@query("validate_series", check="select * from verdicts")
def validate_series(t: Tables):
    return t.verdicts(t.series)


@query("validate_series_strict", check="select * from strict_verdicts")
def validate_series_strict(t: Tables):
    return t.strict_verdicts(t.series)


@query("batch_verdict", check="""
    select bool_and(passed) as passed, 'usual' as gate from verdicts
    union all
    select bool_and(passed) as passed, 'strict' as gate from strict_verdicts
""")
def batch_verdict(t: Tables):
    usual = quality.batch_verdict(t.verdicts(t.stored_series)).withColumn("gate", F.lit("usual"))
    strict = quality.batch_verdict(t.strict_verdicts(t.stored_series)).withColumn("gate", F.lit("strict"))
    return usual.unionByName(strict)


# The series arrives in ten appends, one of them twice; verdicts come from its moments.
@query("validate_series_moments", check="""
    select *, 'usual' as gate from verdicts
    union all
    select *, 'strict' as gate from strict_verdicts
""")
def validate_series_moments(t: Tables):
    path, series = new_location(t.spark, "moments"), t.stored_series
    part = F.pmod(F.xxhash64("job_id", "query_action", "timestamp"), F.lit(10))
    for number in [*range(10), 3]:
        quality.keep_moments(series.where(part == number), path, "appends", number)
    moments = quality.read_moments(t.spark, path)
    usual = quality.validate_moments(moments, t.jobs, t.job_list)
    strict = quality.validate_moments(
        moments, t.jobs, t.job_list, z_limit=STRICT_Z, ignore_nan=True)
    return usual.withColumn("gate", F.lit("usual")).unionByName(strict.withColumn("gate", F.lit("strict")))


# --- promotion ---------------------------------------------------------------

@query("first_wins_promotion", check="""
    select key, pattern, arg_min(job_id, seq) as job_id
    from verdicts where passed group by key, pattern
""")
def first_wins_promotion(t: Tables):
    return promote.first_wins(t.verdicts(t.series))


@query("not_already_cached", check="""
    select job_id, key, pattern from located_jobs l
    where not exists (select 1 from strict_winners w
                      where w.key = l.key and w.pattern = l.pattern)
""")
def not_already_cached(t: Tables):
    located = quality.located_jobs(t.jobs)
    return promote.not_already_cached(located, t.strict_locations(t.series)).select(
        "job_id", "key", "pattern")


@query("missing_runs", check="""
    select prefix || '-' || s || '-' || i as key, r || '-' || w as pattern
    from (select unnest(['sql', 'sqlrep', 'spanner']) as prefix) a,
         (select unnest([1, 2, 3]) as s) b, (select unnest([1, 2, 3]) as i) c,
         (select unnest([1, 2, 3]) as r) d, (select unnest([1, 2, 3]) as w) e
    where not exists (select 1 from strict_winners x
                      where x.key = prefix || '-' || s || '-' || i
                        and x.pattern = r || '-' || w)
""")
def missing_runs(t: Tables):
    return promote.missing_runs(t.spark, t.strict_locations(t.series))


_FIRST_RUN_CHECK = """
    select job_id, db_type, db_size, epoch_us(start) as start_us,
           row_number() over (partition by db_type, db_size order by start, job_id) = 1 as warm_up
    from (select l.job_id, l.db_type, l.db_size, min(x.publish_time) as start
          from located_jobs l join txn x on x.job_id = l.job_id group by all)
"""


@query("first_run_per_instance", check=_FIRST_RUN_CHECK)
def first_run_per_instance(t: Tables):
    starts = t.records.groupBy("job_id").agg(F.min("publish_time").alias("start"))
    runs = promote.first_run_per_instance(quality.located_jobs(t.jobs).join(starts, "job_id"))
    return runs.select("job_id", "db_type", "db_size",
                       F.unix_micros("start").alias("start_us"), "warm_up")


# --- requests ----------------------------------------------------------------

_FIELDS = "read_pattern, write_pattern, intensity, db_type, db_size, sql_size, sql_rep_size, spanner_size"


def _of_mode(test: str) -> str:
    """A test of every field that a request's mode requires, in the checking engine's SQL."""
    modes = {
        "single": "read_pattern write_pattern db_type intensity db_size",
        "fail": "read_pattern write_pattern",
        "run": "read_pattern write_pattern intensity sql_size sql_rep_size spanner_size",
    }
    cases = [f"when '{mode}' then " + " and ".join(test.format(name) for name in names.split())
             for mode, names in modes.items()]
    return f"case mode {' '.join(cases)} else false end"


_REQUEST_FLAGS = f"""
    select *, case when not complete then 'complete' when not integers then 'integers'
                   when not type_ok then 'type_ok' when not size_ok then 'size_ok' end
                   as first_failed_rule,
           complete and integers and type_ok and size_ok as accepted
    from (
        select request_id, mode, {_FIELDS},
               {_of_mode('{0} is not null')} as complete,
               {_of_mode('try_cast({0} as int) is not null')} as integers,
               mode <> 'single' or coalesce(try_cast(db_type as int) between 1 and 3, false) as type_ok,
               mode <> 'single' or coalesce(try_cast(db_size as int) between 1 and 3, false) as size_ok
        from run_requests)
"""


@query("job_request_flags", check=_REQUEST_FLAGS)
def job_request_flags(t: Tables):
    return requests.job_request_flags(t.view("run_requests"))


_EXPANDED = f"""
    select md5(request_id || '|' || slot) as job_id, request_id, slot, db_type, db_size,
           cast(read_pattern as int) as read_pattern, intensity as read_intensity,
           cast(write_pattern as int) as write_pattern, intensity as write_intensity, mode
    from (
        select *, 0 as slot, 1 as db_type, 1 as db_size, 3 as intensity
        from (select request_id, mode, read_pattern, write_pattern
              from ({_REQUEST_FLAGS}) where accepted and mode = 'fail')
        union all
        select request_id, mode, read_pattern, write_pattern, slot, slot + 1 as db_type,
               cast(case slot when 0 then sql_size when 1 then sql_rep_size
                    else spanner_size end as int) as db_size, cast(intensity as int) as intensity
        from (select *, unnest([0, 1, 2]) as slot
              from ({_REQUEST_FLAGS}) where accepted and mode = 'run')
        union all
        select request_id, mode, read_pattern, write_pattern, 0 as slot,
               cast(db_type as int) as db_type, cast(db_size as int) as db_size,
               cast(intensity as int) as intensity
        from ({_REQUEST_FLAGS}) where accepted and mode = 'single')
"""


@query("expand_run_requests", check=f"select * exclude (mode) from ({_EXPANDED})")
def expand_run_requests(t: Tables):
    return requests.expand_run_requests(t.view("run_requests"))


@query("cached_lookup", check=f"""
    select a.request_id, a.key, a.pattern, coalesce(h.cached_rows, 0) as cached_rows,
           h.first_timestamp, h.last_timestamp
    from (select request_id,
                 case db_type when 1 then 'sql' when 2 then 'sqlrep' else 'spanner' end
                     || '-' || db_size || '-' || read_intensity as key,
                 read_pattern || '-' || write_pattern as pattern
          from ({_EXPANDED}) where mode in ('fail', 'run')) a
    left join (select key, pattern, count(*) as cached_rows,
                      min("timestamp") as first_timestamp, max("timestamp") as last_timestamp
               from series s join strict_winners w on s.job_id = w.job_id
               group by key, pattern) h
      on a.key = h.key and a.pattern = h.pattern
""")
def cached_lookup(t: Tables):
    cached = t.stored_series.join(t.strict_locations(t.stored_series), "job_id")
    return requests.cached_lookup(t.view("run_requests"), cached)


# The live cache has the staged rows three times: under two seeds and under none.
def _live(t: Tables) -> str:
    staged, live = _staged(t), new_location(t.spark, "live")
    for seed in (7, 8):
        promote.promote_with_seed(t.spark, staged, live, seed)
    plain = sources.read_cached_series(t.spark, staged).withColumn("seed", F.lit(None).cast("string"))
    occupancy.append(plain, live, stores.LIVE_CACHE_PARTITIONS)
    return live


@query("cached_series", check=f"""
    select key, pattern, {_SERIES}, '7' as seed from staged s
    where exists (
        select 1 from ({_EXPANDED}) a
        where a.mode in ('fail', 'run')
          and s.key = case a.db_type when 1 then 'sql' when 2 then 'sqlrep' else 'spanner' end
                          || '-' || a.db_size || '-' || a.read_intensity
          and s.pattern = a.read_pattern || '-' || a.write_pattern)
""")
def cached_series(t: Tables):
    found = requests.read_series_for(t.spark, t.view("run_requests"), _live(t), seed=7)
    return rounded(found, "average_latency")


@query("cache_occupancy", check="""
    select key, pattern, seed, count(*) as cached_rows, min("timestamp") as first_timestamp,
           max("timestamp") as last_timestamp
    from staged, (values ('7'), ('8'), ('')) s(seed) group by key, pattern, seed
""")
def cache_occupancy(t: Tables):
    return occupancy.occupancy(t.spark, _live(t))


_REGISTRY_FLAGS = """
    select *, case when not complete then 'complete' when not type_ok then 'type_ok'
                   when not size_ok then 'size_ok' when not resource_id_ok then 'resource_id_ok'
                   when not connection_ok then 'connection_ok'
                   when not replica_ok then 'replica_ok' end as first_failed_rule,
           complete and type_ok and size_ok and resource_id_ok and connection_ok and replica_ok
               as accepted
    from (
        select *, database_type is not null and database_size is not null
                  and resource_id is not null and connection_string is not null as complete,
               coalesce(database_type between 1 and 3, false) as type_ok,
               coalesce(database_size between 1 and 3, false) as size_ok,
               coalesce(regexp_full_match(resource_id, '[a-z0-9:-]+'), false) as resource_id_ok,
               coalesce(case when database_type = 3 then connection_string = resource_id
                    else not regexp_matches(connection_string, '^[^0-9.]') end, false) as connection_ok,
               coalesce(database_type <> 2 or replica_ip is not null, false) as replica_ok
        from registry)
"""


@query("resource_quality_flags", check=_REGISTRY_FLAGS)
def resource_quality_flags(t: Tables):
    return requests.resource_quality_flags(t.view("registry"))


# --- charts ------------------------------------------------------------------

@query("series_ordered", check=f"select {_SERIES} from series")
def series_ordered(t: Tables):
    return rounded(charts.series_ordered(t.series), "average_latency")


_POINTS = """
    (select job_id, query_action, average_latency, failure_percent,
            ("timestamp" - min("timestamp") over (partition by job_id)) / 1000.0::double as x
     from series)
"""


@query("chart_series", check=f"""
    select job_id, query_action || '_latency' as line, x, round(average_latency * 1000, 6) as y
    from {_POINTS}
    union all
    select job_id, 'failure_percent' as line, x, round(failure_percent::double, 6) as y
    from {_POINTS}
""")
def chart_series(t: Tables):
    return rounded(charts.chart_series(t.stored_series, ["job_id"]), "y", digits=6)


_LIVE_POINTS = """
    (select key, pattern, seed, query_action, average_latency, failure_percent,
            ("timestamp" - min("timestamp") over (partition by key, pattern)) / 1000.0::double as x
     from staged, (values ('number 7'), ('text 8'), ('none')) s(seed))
"""


@query("chart_series_seeded", check=f"""
    select key, pattern, seed, query_action || '_latency' as line, x,
           round(average_latency * 1000, 6) as y
    from {_LIVE_POINTS}
    union all
    select key, pattern, seed, 'failure_percent' as line, x, round(failure_percent::double, 6) as y
    from {_LIVE_POINTS}
""")
def chart_series_seeded(t: Tables):
    live = sources.read_cached_series(t.spark, _live(t))
    drawn = [charts.chart_series(live, ["key", "pattern"], seed).withColumn("seed", F.lit(label))
             for label, seed in (("number 7", 7), ("text 8", "8"), ("none", None))]
    points = drawn[0].unionByName(drawn[1]).unionByName(drawn[2])
    return rounded(points, "y", digits=6)


# --- streams -----------------------------------------------------------------

def _run_and_close(t: Tables, data: str, start) -> None:
    """Run a stream over all events, then go on with one message a day behind them,
    which closes every window of up to a day.

    ``start`` makes the query of a source of messages that is added to the events.
    """
    topic = new_location(t.spark, "topic")
    t.spark.createDataFrame([], schemas.MESSAGE).write.parquet(topic)
    start(sources.stream_messages(t.spark, topic)).awaitTermination()
    t.given("events").agg(
        (F.max("ts").cast("timestamp") + F.expr("interval 1 day")).alias("publish_time")
    ).withColumn("data", F.lit(data)).write.mode("append").parquet(topic)
    start(sources.stream_messages(t.spark, topic)).awaitTermination()


def _sunk(t: Tables, width: str):
    path, progress = new_location(t.spark, "stream"), new_location(t.spark, "progress")

    def start(last):
        series = streaming.stream_windowed_latency_failure(
            stream_of_messages(t).unionByName(last), width)
        return streaming.start_series_sink(series, path, progress)

    _run_and_close(t, "[]", start)
    return rounded(sources.read_series(t.spark, path), "average_latency")


@query("stream_windowed_latency_failure",
       check=f"select {_SERIES} from ({series_check('txn', 1_000_000)})")
def stream_windowed_latency_failure(t: Tables):
    return _sunk(t, K.RESULT_WINDOW)


def _in_turns(t: Tables, parts: list, delay: str):
    """A stream that stops after each part of its messages and goes on with the next."""
    topic, path = new_location(t.spark, "topic"), new_location(t.spark, "stream")
    progress = new_location(t.spark, "progress")
    for part in parts:
        part.write.mode("append").parquet(topic)
        series = streaming.stream_windowed_latency_failure(
            sources.stream_messages(t.spark, topic), SERIES_WIDTH, delay)
        streaming.start_series_sink(series, path, progress).awaitTermination()
    return sources.read_series(t.spark, path)


_DELAY_US = 10 * 86_400 * 1_000_000
_ON_TIME = f"""
    (select * from txn where event_id % 2 = 0
     or (epoch_us(publish_time) // {SERIES_WIDTH_US} + 1) * {SERIES_WIDTH_US}
        > (select max(epoch_us(publish_time)) - {_DELAY_US} from txn where event_id % 2 = 0))
"""


# Every other transaction arrives after all the rest: those whose window has been
# closed by then, ten days behind the newest, are late and dropped.
@query("stream_watermark", check=f"""
    select {_SERIES} from ({series_check(_ON_TIME, SERIES_WIDTH_US)})
    where "timestamp" + 1 <= (select (max(epoch_us(publish_time)) - {_DELAY_US}) // 1000 from txn)
""")
def stream_watermark(t: Tables):
    first = F.pmod("event_id", F.lit(2)) == 0
    parts = [sources.messages_from_records(t.txn.where(first)),
             sources.messages_from_records(t.txn.where(~first))]
    return rounded(_in_turns(t, parts, "10 days"), "average_latency")


# A message without records, one window after the last, closes every window.
@query("stream_last_window", check=f"select {_SERIES} from series")
def stream_last_window(t: Tables):
    closing = t.messages.agg(
        (F.max("publish_time") + F.expr(f"interval {SERIES_WIDTH}")).alias("publish_time")
    ).withColumn("data", F.lit("[]"))
    return rounded(_in_turns(t, [t.messages, closing], streaming.NO_DELAY), "average_latency")


# Two topics, of which the second goes quiet halfway; messages of the first alone close
# the windows.
@query("stream_quiet_topic", check=f"select {_SERIES} from series")
def stream_quiet_topic(t: Tables):
    path, progress = new_location(t.spark, "stream"), new_location(t.spark, "progress")
    middle = t.given("events").agg(((F.min(F.unix_micros(F.col("ts").cast("timestamp")))
                                     + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2)
                                   .cast("bigint").alias("m")).first()["m"]

    def start(last):
        def topic(second: bool):
            events = t.given_stream("events")
            of_second = (F.pmod("event_id", F.lit(2)) == 0) & (
                F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(middle or 0))
            chosen = F.coalesce(of_second, F.lit(False))
            return sources.messages_from_records(
                t.view("txn", events=events.where(chosen if second else ~chosen)))

        both = streaming.union_of_topics([topic(False).unionByName(last), topic(True)], "1 hour")
        with streaming.slowest_input(t.spark):
            return streaming.start_series_sink(
                streaming.stream_windowed_latency_failure(both, SERIES_WIDTH, None), path, progress)

    _run_and_close(t, "[]", start)
    return rounded(sources.read_series(t.spark, path), "average_latency")


# What the stream holds at its end: the windows of the last ten days, which late records
# may still change.
@query("stream_open_windows", check=f"""
    select job_id, operation as query_action,
           epoch_us(publish_time) // {SERIES_WIDTH_US} * {SERIES_WIDTH_US} as start_us,
           round(coalesce(sum(transaction_end - transaction_start) filter (success), 0), 6) as latency_sum,
           count(*) filter (success) as successes, count(*) as total
    from txn
    where (epoch_us(publish_time) // {SERIES_WIDTH_US} + 1) * {SERIES_WIDTH_US}
          > (select max(epoch_us(publish_time)) - {_DELAY_US} from txn)
    group by job_id, operation, epoch_us(publish_time) // {SERIES_WIDTH_US}
""")
def stream_open_windows(t: Tables):
    progress = new_location(t.spark, "progress")
    series = streaming.stream_windowed_latency_failure(stream_of_messages(t), SERIES_WIDTH, "10 days")
    streaming.start_series_sink(series, new_location(t.spark, "stream"), progress).awaitTermination()
    return streaming.read_open_windows(t.spark, progress).select(
        "job_id", "query_action", F.unix_micros("start").alias("start_us"),
        F.round(F.coalesce("latency_sum", F.lit(0.0)), 6).alias("latency_sum"), "successes", "total")


@query("series_sink", check=f"select {_SERIES} from series")
def series_sink(t: Tables):
    return _sunk(t, SERIES_WIDTH)


_SLOT_MS = 30 * 86_400_000


def _upserted(t: Tables) -> str:
    """The series as upserts: every other transaction after all the rest, so the second
    run changes windows of the first one."""
    path, progress, topic = [new_location(t.spark, n) for n in ("upserts", "progress", "topic")]
    for remainder in (0, 1):
        part = t.txn.where(F.pmod("event_id", F.lit(2)) == remainder)
        sources.messages_from_records(part).write.mode("append").parquet(topic)
        series = streaming.stream_windowed_latency_failure(
            sources.stream_messages(t.spark, topic), SERIES_WIDTH, "10000 days")
        streaming.start_series_upserts(series, path, progress, slot_ms=_SLOT_MS).awaitTermination()
    return path


@query("series_upsert_sink", check=f"select {_SERIES} from series")
def series_upsert_sink(t: Tables):
    return rounded(streaming.read_latest_series(t.spark, _upserted(t)), "average_latency")


# The newest sixty days of the table: slots before them are not read.
@query("series_upsert_range", check=f"""
    select {_SERIES} from series
    where "timestamp" > (select max(epoch_ms(publish_time)) - 60 * 86400000::bigint from txn)
""")
def series_upsert_range(t: Tables):
    last = t.txn.agg(F.max(F.unix_millis("publish_time"))).first()[0]
    path = _upserted(t)
    newest = streaming.read_latest_series(
        t.spark, path, (last - 60 * 86_400_000 + 1, last + 86_400_000), slot_ms=_SLOT_MS)
    return rounded(newest, "average_latency")


@query("stream_sql_windowed_latency", check=_prototype_check(5_000_000))
def stream_sql_windowed_latency(t: Tables):
    path, progress = new_location(t.spark, "stream"), new_location(t.spark, "progress")

    def start(last):
        proto = t.view("proto", events=t.given_stream("events"))
        results = streaming.stream_sql_windowed_latency(t.object_messages(proto).unionByName(last))
        return (results.writeStream.format("parquet").outputMode("append").option("path", path)
                .option("checkpointLocation", progress).trigger(availableNow=True).start())

    _run_and_close(t, "{}", start)
    return t.spark.read.parquet(path)


def _split(t: Tables) -> str:
    """Damaged messages, split as a stream."""
    path = new_location(t.spark, "split")
    streaming.start_parse_with_quarantine(
        damaged_messages(t, t.given_stream("events")), path,
        new_location(t.spark, "progress")).awaitTermination()
    return path


@query("stream_parse_quarantine", check=f"""
    select {OUTCOME_CHECK} as outcome, cast(null as varchar) as job_id,
           epoch_us(publish_time) as publish_us
    from txn where {OUTCOME_CHECK} is not null
    union all
    select 'accepted', job_id, epoch_us(publish_time) from txn
    where event_id % {DAMAGE_KINDS} in {SOUND_RECORD}
""")
def stream_parse_quarantine(t: Tables):
    split = streaming.read_split(t.spark, _split(t))
    at = F.unix_micros("publish_time").alias("publish_us")
    accepted = parse.accepted_records(split).select(F.lit(parse.ACCEPTED).alias("outcome"), "job_id", at)
    rejected = parse.rejected_payloads(split).select(
        F.col("rejected").alias("outcome"), F.lit(None).cast("string").alias("job_id"), at)
    return accepted.unionByName(rejected)


@query("stream_split_counts", check=f"""
    select cast(count(*) as bigint) as messages,
           cast(sum(case when event_id % {DAMAGE_KINDS} = 5 then 2 else 1 end) as bigint) as elements,
           count(*) filter (event_id % {DAMAGE_KINDS} in {SOUND_RECORD}) as accepted,
           count(*) filter ({OUTCOME_CHECK} = 'record') as record,
           count(*) filter ({OUTCOME_CHECK} = 'message') as message
    from txn
""")
def stream_split_counts(t: Tables):
    counts = streaming.read_split_counts(t.spark, _split(t))
    return counts.agg(*[F.sum(c).alias(c) for c in streaming.SPLIT_COUNTS])


@query("stream_lease_sweep", check="""
    select resource_id, database_type, database_size, expiry, status, connection_string, replica_ip
    from resources where status = 'leased' and expiry < (select epoch_us(max(ts)) / 1000000.0 from events)
""")
def stream_lease_sweep(t: Tables):
    path = new_location(t.spark, "sweeps")
    ticks = t.given_stream("events").select(F.col("ts").cast("timestamp").alias("timestamp"))
    streaming.start_lease_sweep(
        ticks, lambda spark: t.view("resources"), path, new_location(t.spark, "progress"),
        interval=None,
    ).awaitTermination()
    # A resource stays in the sweep set until it is cleaned: take each once.
    return t.spark.read.parquet(path).drop("sweep").distinct()
