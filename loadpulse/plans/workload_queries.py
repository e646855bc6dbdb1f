"""The relational workload, the resource pool and planned load."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas, sources
from ..operators import ids, load, pool, workload
from ..session import new_location
from ..sources.tables import values_text
from ..streaming import jobs as streaming
from .registry import query, rounded
from .views import CHECK_ONLY, NOW, Tables

# --- pictures ------------------------------------------------------------------


@query("pictures_scan", check="select * from pictures")
def pictures_scan(t: Tables):
    return t.pictures


@query("pictures_fill_color", check="""
    select c.color from picture_rows p join colors c on p.fillColor = c.id
""")
def pictures_fill_color(t: Tables):
    return workload.pictures_fill_color(t.picture_codes, t.dimension("colors"))


@query("pictures_two_shapes", check="""
    select a.shape as shape1, b.shape as shape2
    from picture_rows p join shapes a on p.shape1 = a.id join shapes b on p.shape2 = b.id
""")
def pictures_two_shapes(t: Tables):
    return workload.pictures_two_shapes(t.picture_codes, t.dimension("shapes"))


@query("pictures_star", check="""
    select c1.color as lineColor, c2.color as fillColor, s1.shape as shape1, s2.shape as shape2,
           a.artist
    from picture_rows p join colors c1 on p.lineColor = c1.id join colors c2 on p.fillColor = c2.id
    join shapes s1 on p.shape1 = s1.id join shapes s2 on p.shape2 = s2.id
    join artists a on p.artist = a.id
""")
def pictures_star(t: Tables):
    return workload.pictures_star(
        t.picture_codes, t.dimension("colors"), t.dimension("shapes"), t.dimension("artists"))


@query("pictures_count", check="select count(*) as pictures from lineitem")
def pictures_count(t: Tables):
    return workload.pictures_count(t.picture_codes)


@query("dimension_tables", check="""
    select d.*, coalesce(u.uses, 0) as uses
    from (select 'colors' as dimension, id, color as name, hex as detail from colors
          union all select 'shapes', id, shape, sides::varchar from shapes
          union all select 'artists', id, artist, age::varchar from artists) d
    left join (select dimension, id, count(*) as uses
               from (select 'colors' as dimension, lineColor as id from picture_rows
                     union all select 'colors', fillColor from picture_rows
                     union all select 'shapes', shape1 from picture_rows
                     union all select 'shapes', shape2 from picture_rows
                     union all select 'artists', artist from picture_rows)
               group by all) u
      on u.dimension = d.dimension and u.id = d.id
""")
def dimension_tables(t: Tables):
    return workload.dimension_usage(
        t.picture_codes, t.dimension("colors"), t.dimension("shapes"), t.dimension("artists"))


_CODES = ", ".join(workload.CHANGEABLE)


@query("pictures_append", check=f"""
    select * from pictures
    union all
    select (select count(*) from lineitem) + row_number() over (order by o_orderkey) as id, {_CODES}
    from picture_inserts
""")
def pictures_append(t: Tables):
    return workload.pictures_append(t.pictures, t.view("picture_inserts"), ["o_orderkey"])


_APPENDS = 3


def _pictures_by_ledger(t: Tables):
    """Pictures, then inserts in three appends, under ids that a ledger hands out; the
    last append runs twice."""
    path = new_location(t.spark, "pictures")
    ids.append_with_ids(t.picture_codes, path, "load")
    inserts = t.view("picture_inserts")
    for turn in [*range(_APPENDS), _APPENDS - 1]:
        part = inserts.where(F.pmod("o_orderkey", F.lit(_APPENDS)) == turn)
        ids.append_with_ids(part.select(*workload.CHANGEABLE), path, "inserts", turn)
    return ids.read_with_ids(t.spark, path, schemas.PICTURE)


_LEDGER_PARTS = f"""
    (select -1 as turn, {_CODES} from picture_rows
     union all select o_orderkey % {_APPENDS}, {_CODES} from picture_inserts)
"""
_LEDGER_FIRST = "cast(1 + coalesce(sum(pictures) over (order by turn rows between unbounded preceding and 1 preceding), 0) as bigint)"
_LEDGER_RANGES = f"""
    (select turn, pictures, {_LEDGER_FIRST} as first_id
     from (select turn, count(*) as pictures from {_LEDGER_PARTS} group by turn))
"""


# Which row of an append has which of its ids is open; that it has one of them is not.
@query("pictures_append_by_ledger", check=f"""
    select p.* exclude (turn), r.first_id, true as own_range
    from {_LEDGER_PARTS} p join {_LEDGER_RANGES} r on p.turn = r.turn
""")
def pictures_append_by_ledger(t: Tables):
    kept = _pictures_by_ledger(t)
    rows = kept.groupBy(ids.BATCH).agg(F.count("*").alias("_rows")).withColumnRenamed(ids.BATCH, "first")
    own = F.col("id").between(F.col("first"), F.col("first") + F.col("_rows") - 1)
    return kept.join(rows, F.col(ids.BATCH) == F.col("first")).select(
        *workload.CHANGEABLE, ids.BATCH, own.alias("own_range"))


@query("picture_id_ranges", check=f"""
    select first_id, first_id + pictures - 1 as last_id, pictures, pictures as ids
    from {_LEDGER_RANGES}
""")
def picture_id_ranges(t: Tables):
    kept = _pictures_by_ledger(t)
    # Ids are unique in the whole table if each range is as long as its distinct ids.
    each = kept.groupBy("id").agg(F.min(ids.BATCH).alias(ids.BATCH), F.count("*").alias("n"))
    return each.groupBy(ids.BATCH).agg(
        F.max("id").alias("last_id"), F.sum("n").alias("pictures"), F.count("*").alias("ids"))


def _text_ids(kind: str, rows: str, key: str) -> str:
    """Rows with their text ids in the checking engine's SQL."""
    codes = " || '|' || ".join(f"coalesce({c}::varchar, '')" for c in workload.CHANGEABLE)
    return f"""
        select *, md5('{kind}|' || coalesce({key}::varchar, '') || '|' || {codes} || '|'
                      || row_number() over (partition by {key}, {_CODES})) as id
        from {rows}
    """


CHECK_ONLY["text_pictures"] = _text_ids("line", "picture_rows", "row_key")


@query("pictures_append_text_id", check=f"""
    select id, {_CODES} from text_pictures
    union all
    select id, {_CODES} from ({_text_ids('order', 'picture_inserts', 'o_orderkey')})
""")
def pictures_append_text_id(t: Tables):
    pictures = workload.with_unique_text_ids(t.view("picture_rows"), "line", ["row_key"])
    inserts = workload.with_unique_text_ids(t.view("picture_inserts"), "order", ["o_orderkey"])
    return pictures.select("id", *workload.CHANGEABLE).unionByName(inserts.select("id", *workload.CHANGEABLE))


@query("text_ids_are_unique", check="""
    select count(*) as pictures, count(*) as ids from picture_rows
""")
def text_ids_are_unique(t: Tables):
    pictures = workload.with_unique_text_ids(t.view("picture_rows"), "line", ["row_key"])
    return pictures.groupBy("id").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("pictures"), F.count("*").alias("ids"))


# A change names an order: it is one of each picture of the order's first line.
@query("pictures_apply_updates_text_id", check="""
    select p.id, """ + ", ".join(
        f"coalesce(u.new_{c}, p.{c}) as {c}" for c in workload.CHANGEABLE) + """
    from text_pictures p
    left join (
        select id, """ + ", ".join(
            f"arg_max(val, seq) filter (col = '{c}') as new_{c}" for c in workload.CHANGEABLE) + """
        from (select n.id, c.seq, c.col, c.val from picture_changes c
              join text_pictures n on split_part(n.row_key, '|', 1) = c.id::varchar
                                   and split_part(n.row_key, '|', 2) = '1')
        group by id) u on p.id = u.id
""")
def pictures_apply_updates_text_id(t: Tables):
    pictures = workload.with_unique_text_ids(t.view("picture_rows"), "line", ["row_key"])
    parts = F.split("row_key", "[|]")
    first_lines = pictures.where(parts[1] == "1").select(
        parts[0].cast("bigint").alias("order"), F.col("id").alias("picture"))
    changes = t.view("picture_changes").join(first_lines, F.col("id") == F.col("order")).select(
        F.col("picture").alias("id"), "seq", "col", "val")
    return workload.pictures_apply_updates(pictures.select("id", *workload.CHANGEABLE), changes)


@query("pictures_apply_updates", check="""
    select p.id, """ + ", ".join(
        f"coalesce(u.new_{c}, p.{c}) as {c}" for c in workload.CHANGEABLE) + """
    from pictures p left join (
        select id, """ + ", ".join(
            f"arg_max(val, seq) filter (col = '{c}') as new_{c}" for c in workload.CHANGEABLE) + """
        from picture_changes group by id) u on p.id = u.id
""")
def pictures_apply_updates(t: Tables):
    return workload.pictures_apply_updates(t.pictures, t.view("picture_changes"))


@query("workload_mix", check="""
    select m.kind, count(k.kind) as writes, m.intended,
           round(count(k.kind) / (select count(*) from write_kinds), 9) as share
    from (values %s) m(kind, intended) left join write_kinds k on k.kind = m.kind
    group by m.kind, m.intended
""" % values_text([(k, s) for k, s in K.INTENDED_MIX.items()]).replace("0.7", "0.7::double")
      .replace("0.1", "0.1::double"))
def workload_mix(t: Tables):
    return rounded(workload.workload_mix(t.view("write_kinds")), "share")


# --- resource pool -------------------------------------------------------------

@query("status_filters", check=f"""
    select resource_id, 'down' as condition from resources where status = 'down'
    union all select resource_id, 'ready' as condition from resources where status = 'ready'
    union all select resource_id, 'expired' as condition from resources where expiry < {NOW}
""")
def status_filters(t: Tables):
    return pool.status_filters(t.view("resources"), NOW)


@query("expired_leases", check=f"""
    select resource_id, database_type, database_size, expiry, status, connection_string, replica_ip from resources
    where status = 'leased' and expiry < {NOW}
""")
def expired_leases(t: Tables):
    return pool.expired_leases(t.view("resources"), NOW)


@query("earliest_expiry_top1", check="""
    select resource_id, database_type, database_size, expiry, status, connection_string, replica_ip from resources
    order by expiry, resource_id limit 1
""")
def earliest_expiry_top1(t: Tables):
    return pool.earliest_expiry(t.view("resources"))


@query("lease_candidate", check="""
    select database_type, database_size, resource_id, expiry, connection_string, replica_ip
    from (select *, row_number() over (partition by database_type, database_size
                                       order by expiry, resource_id) as n from resources)
    where n = 1 and status = 'ready'
""")
def lease_candidate(t: Tables):
    return pool.lease_candidate(t.view("resources"))


@query("pool_status", check="""
    select database_type, database_size, count(*) filter (status = 'ready') as ready,
           count(*) filter (status = 'leased') as leased,
           count(*) filter (status = 'cleaning') as cleaning,
           count(*) filter (status = 'down') as down,
           count(*) filter (status = 'ready') > 0 as available
    from resources group by database_type, database_size
""")
def pool_status(t: Tables):
    return pool.pool_status(t.view("resources"))


_RESOURCE_STATE = """
    select r.resource_id, r.database_type, r.database_size,
           coalesce(l.new_expiry, r.expiry) as expiry, coalesce(l.new_status, r.status) as status,
           r.connection_string, r.replica_ip
    from resources r left join (
        select resource_id, arg_max(status, seq) as new_status,
               arg_max(expiry, seq) filter (status = 'leased') as new_expiry
        from lease_log group by resource_id) l on r.resource_id = l.resource_id
"""


@query("resource_state_after", check=_RESOURCE_STATE)
def resource_state_after(t: Tables):
    return pool.resource_state_after(t.view("resources"), t.view("lease_log")).select(
        "resource_id", "database_type", "database_size", "expiry", "status", "connection_string",
        "replica_ip")


# Changes arrive in an order of their own, a part of them twice.
@query("stream_resource_state", check=_RESOURCE_STATE)
def stream_resource_state(t: Tables):
    topic, path, progress = [new_location(t.spark, n) for n in ("changes", "resource-state", "progress")]
    log = t.view("lease_log")
    for part in (2, 0, 1, 2):
        log.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == part).write.mode("append").parquet(topic)
        changes = t.spark.readStream.schema(log.schema).option(
            "maxFilesPerTrigger", sources.FILES_PER_BATCH).parquet(topic)
        streaming.start_resource_state(t.view("resources"), changes, path, progress).awaitTermination()
    return streaming.read_resource_state(t.spark, path)


@query("register_resources", check=f"""
    select q.seq, q.resource_id, q.database_type, q.database_size, q.connection_string, q.replica_ip,
           case when added then 'added' else 'already in pool' end as outcome,
           case when added then 'ready' end as status,
           case when added then ({NOW} - 10)::double end as expiry
    from (select r.*, n = 1 and not exists (
                     select 1 from resources x where x.resource_id = r.resource_id
                       and x.database_type = r.database_type
                       and x.database_size = r.database_size) as added
          from (select *, row_number() over (partition by database_type, database_size, resource_id
                                             order by seq) as n from registrations) r) q
""")
def register_resources(t: Tables):
    outcome = pool.register_resources(t.view("resources"), t.view("registrations"), NOW)
    return outcome.select("seq", "resource_id", "database_type", "database_size", "outcome",
                          "status", "expiry", "connection_string", "replica_ip")


# --- planned load --------------------------------------------------------------

_SEGMENT_ROWS = [
    (pattern, i, sum(s for s, _ in segments[:i]), seconds, qps)
    for pattern, segments in K.LOAD_PATTERNS.items()
    for i, (seconds, qps) in enumerate(segments)
]


def _schedule_check(operation: str) -> str:
    return f"""
        select j.job_id, '{operation}' as operation, g.segment, cast(turn as int) as turn,
               round(g.start_second + g.turn * (1.0::double / g.qps), 9) as offset_seconds,
               case {operation}_intensity when 2 then 6 when 3 then 12
                    else {operation}_intensity end as pods
        from (select pattern, segment, start_second, qps,
                     unnest(range(cast(seconds * qps as int))) as turn
              from (values {values_text(_SEGMENT_ROWS)})
                   v(pattern, segment, start_second, seconds, qps)) g
        join jobs j on j.{operation}_pattern = g.pattern
    """


@query("expected_load", check=_schedule_check("read"))
def expected_load(t: Tables):
    return rounded(load.expected_load(t.jobs, "read"), "offset_seconds")


@query("planned_reads_and_writes",
       check=f"{_schedule_check('read')} union all {_schedule_check('write')}")
def planned_reads_and_writes(t: Tables):
    return rounded(load.planned_reads_and_writes(t.jobs), "offset_seconds")


@query("expected_vs_observed", check=f"""
    select coalesce(e.job_id, o.job_id) as job_id, coalesce(e.operation, o.operation) as operation,
           cast(coalesce(e.expected, 0) as bigint) as expected,
           coalesce(o.observed, 0) as observed
    from (select job_id, operation, sum(pods) as expected
          from ({_schedule_check('read')} union all {_schedule_check('write')})
          group by job_id, operation) e
    full outer join (select job_id, operation, count(*) as observed from txn
                     group by job_id, operation) o
      on e.job_id = o.job_id and e.operation = o.operation
""")
def expected_vs_observed(t: Tables):
    return load.expected_vs_observed(t.jobs, t.records)
