"""Stream query, dashboard, paging and severity statistics."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import levels
from ..operators import stream_query as sq
from ..sources.tables import AS_OF
from .registry import query

_COLS = ", ".join(sq.STREAM_COLUMNS)
_TOP = "order by timestamp desc, id desc limit"
WEEK = "2024-01-24T00:00:00.000Z"
_ERRORS = "('error','critical','alert','emergency')"


@query("a55_severity_stats", f"""select project_id, count(*) as total, count(*) filter (where level = 'warning') as warnings,
  count(*) filter (where level in {_ERRORS}) as errors from log_entries where timestamp >= '{WEEK}' group by project_id""")
def severity_stats(t):
    return sq.severity_stats(sq.in_range(t.log_entries(), "7d", AS_OF), "project_id")


@query("a27_stream_query", f"""select {_COLS} from log_entries where project_id = 'proj-1' and level in ('error','critical')
  and environment = 'production' and message ilike '%declined%' and timestamp < '2024-01-20T00:00:00.000Z' {_TOP} 100""")
def stream_query(t):
    return sq.stream_query(t.log_entries(), project="proj-1", level="error, CRITICAL,bogus", environment="production",
                           q="declined", before="2024-01-20T00:00:00.000Z")


@query("a27a_level_set", f"select {_COLS} from log_entries where level in ('warning','alert')")
def level_set(t):
    return sq.stream_filter(t.log_entries(), level=" Warning ,alert,nope").select(*sq.STREAM_COLUMNS)


@query("a27a_level_set_all_invalid", "select count(*) as n from log_entries")
def level_set_invalid(t):
    return sq.stream_filter(t.log_entries(), level="trace,success").agg(F.count("*").alias("n"))


@query("a27b_channel_environment", f"select {_COLS} from log_entries where channel = 'http' and environment = 'staging'")
def channel_environment(t):
    return sq.stream_filter(t.log_entries(), channel="http", environment="staging").select(*sq.STREAM_COLUMNS)


@query("a27c_trace_request", f"""select {_COLS}, 'trace' as via from log_entries where trace_id = md5('7/3')
  union all select {_COLS}, 'request' from log_entries where request_id = 'req-40'""")
def trace_request(t):
    trace = hashlib.md5(b"7/3").hexdigest()
    log = t.log_entries()
    by_trace = sq.stream_filter(log, trace=trace).withColumn("via", F.lit("trace"))
    by_request = sq.stream_filter(log, request="req-40").withColumn("via", F.lit("request"))
    return by_trace.unionByName(by_request).select(*sq.STREAM_COLUMNS, "via")


@query("a27d_message_search", r"""select id, message from log_entries where message ilike '%sub\_1%4_ declined%' escape '\'""")
def message_search(t):
    return t.log_entries().where(sq.message_search(r"sub\_1%4_ declined")).select("id", "message")


@query("a27e_before_cursor", f"select id, timestamp from log_entries where timestamp < '{WEEK}'")
def before_cursor(t):
    return sq.stream_filter(t.log_entries(), before=WEEK).select("id", "timestamp")


@query("a27f_limit_rule", f"""select * from (select 'top' as rule, id from log_entries {_TOP} 200) union all
  select * from (select 'zero' as rule, id from log_entries {_TOP} 100) union all select * from (select 'negative' as rule, id from log_entries {_TOP} 1)""")
def limit_rule(t):
    parts = [sq.stream_query(t.log_entries(), limit=n).select(F.lit(rule).alias("rule"), "id")
             for rule, n in (("top", 1000), ("zero", 0), ("negative", -5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a28_dashboard_query", f"""select id, level, message, channel, environment, release, framework, host, context, timestamp from log_entries
  where project_id = 'proj-2' and level in {_ERRORS} and timestamp >= '{WEEK}' and message ilike '%after%' {_TOP} 50""")
def dashboard_query(t):
    hits = sq.dashboard_filter(t.log_entries(), AS_OF, project="proj-2", floor="error", range_key="7d", q="after")
    return sq.dashboard_page(hits).select("id", "level", "message", "channel", "environment", "release", "framework", "host", "context", "timestamp")


@query("a28_dashboard_ranges", """select '1h' as range, 'warning' as floor, count(*) as n from log_entries where level in ('warning','error','critical','alert','emergency') and timestamp >= '2024-01-30T23:00:00.000Z'
  union all select '24h', 'debug', count(*) from log_entries where timestamp >= '2024-01-30T00:00:00.000Z'
  union all select 'all', 'info', count(*) from log_entries where level <> 'debug'
  union all select 'odd', 'all', count(*) from log_entries where timestamp >= '2024-01-30T00:00:00.000Z'""")
def dashboard_ranges(t):
    out = None
    for range_key, floor in (("1h", "warning"), ("24h", "debug"), ("all", "info"), ("odd", "all")):
        part = sq.dashboard_filter(t.log_entries(), AS_OF, floor=floor, range_key=range_key).agg(F.count("*").alias("n"))
        part = part.select(F.lit(range_key).alias("range"), F.lit(floor).alias("floor"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("a29_fixable", "select id, level in ('warning','error','critical','alert','emergency') as fixable from log_entries")
def fixable(t):
    return t.log_entries().select("id", levels.fixable(F.upper("level")).alias("fixable"))


@query("a03b_point_lookup", "select * from log_entries where id = 'e4711' or id = 'e0' limit 2")
def point_lookup(t):
    log = t.log_entries()
    return log.where(F.col("id") == "e4711").limit(1).unionByName(log.where(F.col("id") == "e0").limit(1))


@query("a56_pager", """select n as total, p as pages, least(7, p) as page, (least(7, p) - 1) * 50 + 1 as from_row, least(least(7, p) * 50, n) as to_row,
  least(7, p) > 1 as has_prev, least(7, p) < p as has_next
  from (select count(*) as n, greatest(1, cast(ceil(count(*) / 50.0) as bigint)) as p from log_entries where level in ('error','critical','alert','emergency'))""")
def pager(t):
    return sq.pager(sq.dashboard_filter(t.log_entries(), AS_OF, floor="error", range_key="all"), requested=7)


@query("a58_offset_page", f"select id, timestamp, message from log_entries where project_id = 'proj-0' {_TOP} 50 offset 100")
def offset_page(t):
    return sq.dashboard_page(t.log_entries().where(F.col("project_id") == "proj-0"), page=3).select("id", "timestamp", "message")


@query("a59_keyset_page", f"""with page as (select id, timestamp from log_entries where timestamp < '{WEEK}' {_TOP} 100)
  select count(*) as rows, case when count(*) = 100 then min(timestamp) end as next_cursor from page""")
def keyset_page(t):
    return sq.next_cursor(sq.stream_query(t.log_entries(), before=WEEK), 100)


@query("a59_keyset_page_safe", f"""select id, day from (select id, substring(timestamp, 1, 10) as day from log_entries)
  where day < '2024-01-20' or (day = '2024-01-20' and id < 'e6400') order by day desc, id desc limit 100""")
def keyset_page_safe(t):
    # day-coarsened times make nearly every row a tie
    days = t.log_entries().select("id", F.substring("timestamp", 1, 10).alias("timestamp"))
    return sq.page_after(days, "2024-01-20", "e6400", 100).select("id", F.col("timestamp").alias("day"))
