"""Quotas, throttles and the full admission verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import ingest, quota
from ..operators.lineage import cut
from .ingest import _ACCOUNT_SQL
from .registry import query

HOUR = 3_600_000


def _hits(t):
    """One hit per event, keyed by project; the charge varies with the event."""
    return t.events.select(
        F.col("event_id").alias("hit_id"), F.concat(F.lit("proj:"), (F.col("user_id") % 5).cast("string")).alias("key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("event_id") % 4 + 1).cast("bigint").alias("charge"))


def _burst(t):
    """Whole-minute times and one key for half of the events: heavy ties, one hot key."""
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("hit_id"),
        F.when(kind.isin("click", "view", "error"), "ip:hot").otherwise(F.concat(F.lit("ip:"), F.col("user_id").cast("string"))).alias("key"),
        (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 7_200_000) * 7_200_000).cast("bigint").alias("ms"),
        F.lit(1).cast("bigint").alias("charge"))


_HITS = "hits as (select event_id as hit_id, 'proj:' || (user_id % 5) as key, epoch_us(ts) // 1000 as ms, event_id % 4 + 1 as charge from events)"
_BURST = """hits as (select event_id as hit_id, case when event_type in ('click','view','error') then 'ip:hot' else 'ip:' || user_id end as key,
  epoch_us(ts) // 1000 // 7200000 * 7200000 as ms, 1 as charge from events)"""


def _windows_sql(window_ms, tag=""):
    return f"""d{tag} as (select key, ms, sum(charge) as charge from hits{tag} group by key, ms),
  nxt{tag} as (select key, ms, min(ms) over (partition by key order by ms range between {window_ms} following and unbounded following) as nx from d{tag}),
  opens{tag} as (select key, min(ms) as ms from d{tag} group by key union all select n.key, n.nx from opens{tag} o join nxt{tag} n on n.key = o.key and n.ms = o.ms where n.nx is not null),
  w{tag} as (select h.*, o.ms as opened from hits{tag} h asof join opens{tag} o on h.key = o.key and h.ms >= o.ms),
  run{tag} as (select *, coalesce(sum(charge) over (partition by key, opened order by ms, hit_id rows between unbounded preceding and 1 preceding), 0) as prior from w{tag})"""


def _verdict_sql(limit, window_ms, mode):
    if mode == "memory":
        ok, retry = f"prior < {limit}", f"greatest(1, ceil((opened + {window_ms} - ms) / 1000.0))"
    else:
        ok = f"prior + charge <= {limit}"
        retry = f"case when floor((opened + {window_ms} - ms + 500) / 1000.0) <= 0 then {window_ms // 1000} else floor((opened + {window_ms} - ms + 500) / 1000.0) end"
    return f"select hit_id, key, cast(opened as bigint) as opened, {ok} as ok, case when not ({ok}) then cast({retry} as integer) end as retry_after from run"


def _register(name, hits_sql, hits, limit, window_ms, mode):
    @query(name, f"with recursive {hits_sql}, {_windows_sql(window_ms)} {_verdict_sql(limit, window_ms, mode)}")
    def run(t):
        return quota.rate_limit(hits(t), limit, window_ms, mode).select("hit_id", "key", "opened", "ok", "retry_after")


_register("a41_fixed_window_memory", _HITS, _hits, 20, 6 * HOUR, "memory")
_register("a41_fixed_window_memory_burst", _BURST, _burst, 30, 10 * HOUR, "memory")
_register("a42_fixed_window_shared", _HITS, _hits, 20, 6 * HOUR, "shared")
_register("a42_fixed_window_shared_burst", _BURST, _burst, 30, 10 * HOUR, "shared")


@query("a43_aligned_window", f"""with {_HITS}, run as (select *, ms // {6 * HOUR} * {6 * HOUR} as opened, coalesce(sum(charge) over (partition by key, ms // {6 * HOUR} order by ms, hit_id
    rows between unbounded preceding and 1 preceding), 0) as prior from hits) {_verdict_sql(20, 6 * HOUR, 'memory')}""")
def aligned_window(t):
    return quota.rate_limit(_hits(t), 20, 6 * HOUR, aligned=True).select("hit_id", "key", "opened", "ok", "retry_after")


@query("a44_ingest_budgets", f"""with req as (select request_id, received_at, cast(least(n, 500) as bigint) as charge, header_project, forwarded_for from raw_requests join ({_ACCOUNT_SQL}) a using (request_id)
   where n > 0), hits as (select request_id as hit_id, 'ip:' || trim(string_split(forwarded_for, ',')[2]) as key, epoch_ms(cast(received_at[1:23] as timestamp)) as ms, 1 as charge, 'ip' as budget from req
   union all select request_id, 'proj:' || coalesce(header_project, 'by-key'), epoch_ms(cast(received_at[1:23] as timestamp)), charge, 'project' from req),
  run as (select *, coalesce(sum(charge) over (partition by key, ms // 10000 order by ms, hit_id rows between unbounded preceding and 1 preceding), 0) as prior from hits)
  select budget, key, count(*) as hits, count(*) filter (where prior >= case budget when 'ip' then 4000 else 2000 end) as refused from run group by budget, key""")
def ingest_budgets(t):
    ip = text.client_ip(F.col("forwarded_for"), F.col("real_ip"), F.col("direct_ip"))
    # parsed once; both budgets read it several times
    req = cut(ingest.accounting(t.heavy.raw_requests()).where("n > 0").select(
        "request_id", "header_project", "n", ip.alias("ip"), F.unix_millis(times.event_ts(F.col("received_at"))).alias("ms")))
    by_ip = req.select(F.col("request_id").alias("hit_id"), F.concat(F.lit("ip:"), "ip").alias("key"), "ms", F.lit(1).cast("bigint").alias("charge"))
    by_project = req.select(F.col("request_id").alias("hit_id"), F.concat(F.lit("proj:"), F.coalesce("header_project", F.lit("by-key"))).alias("key"), "ms",
                            F.least(F.col("n"), F.lit(ingest.MAX_BATCH)).cast("bigint").alias("charge"))
    out = None
    for budget, hits in (("ip", by_ip), ("project", by_project)):
        limit, window_ms = quota.BUDGETS[budget]
        v = quota.rate_limit(hits, limit, window_ms, aligned=True).groupBy("key").agg(
            F.count("*").alias("hits"), F.count_if(~F.col("ok")).alias("refused")).withColumn("budget", F.lit(budget))
        out = v if out is None else out.unionByName(v)
    return out


@query("a45_open_windows", f"""with recursive {_HITS.replace("hits as", "all_hits as", 1)}, hits as (select * from all_hits where ms <= 1706616000000), {_windows_sql(6 * HOUR)}
  select key, cast(opened as bigint) as opened, cast(sum(charge) filter (where prior < 20) as bigint) as count, cast(opened + {6 * HOUR} as bigint) as reset_at from run
  where opened <= 1706616000000 and opened + {6 * HOUR} > 1706616000000 group by key, opened""")
def open_windows(t):
    # counters alive at 2024-01-30 12:00
    return quota.open_windows(_hits(t), 20, 6 * HOUR, 1706616000000)


@query("a66_alert_throttle", f"""with recursive hits as (select id as hit_id, project_id as key, epoch_ms(cast(timestamp[1:23] as timestamp)) as ms, 1 as charge from log_entries
    where level in ('error','critical','alert','emergency')), {_windows_sql(24 * HOUR)} select hit_id as id, key as project_id, prior < 15 as sent from run""")
def alert_throttle(t):
    # a day instead of an hour, so that the throttle bites on this data
    limit, _ = quota.BUDGETS["alert"]
    hits = t.log_entries().where(F.col("level").isin("error", "critical", "alert", "emergency")).select(
        F.col("id").alias("hit_id"), F.col("project_id").alias("key"), F.unix_millis(times.event_ts(F.col("timestamp"))).alias("ms"), F.lit(1).cast("bigint").alias("charge"))
    return quota.rate_limit(hits, limit, 24 * HOUR).select(F.col("hit_id").alias("id"), F.col("key").alias("project_id"), F.col("ok").alias("sent"))


@query("b91_points_limiter", f"""with recursive {_HITS}, {_windows_sql(6 * HOUR)}
  select key, cast(opened as bigint) as opened, count(*) filter (where prior < 20) as accepted, count(*) filter (where prior >= 20) as refused,
    cast(coalesce(sum(charge) filter (where prior < 20), 0) as bigint) as used, cast(greatest(0, 20 - coalesce(sum(charge) filter (where prior < 20), 0)) as bigint) as remaining from run group by key, opened""")
def points_limiter(t):
    hits = _hits(t)
    windows = quota.anchored_windows(hits, 6 * HOUR)
    return quota.budget_use(hits, windows, quota.decide(hits, windows, 20, 6 * HOUR), 20)


_ADMISSION = f"""acc as ({_ACCOUNT_SQL}),
  v as (select r.request_id, a.n, a.stored, a.dropped, a.skipped, r.received_at, r.header_key, p.id as pid, p.ingest_key, p.is_active,
      cast(case when a.n = 0 then 400 when p.id is null then 404 when p.is_active = false then 403 when coalesce(p.ingest_key, '') = '' then 403
        when coalesce(r.header_key, '') <> p.ingest_key then 401 else 201 end as integer) as status
    from raw_requests r join acc a using (request_id)
    left join projects p on (r.header_project is not null and p.id = r.header_project) or (r.header_project is null and p.ingest_key = r.header_key))"""


@query("a30_admission", f"""with {_ADMISSION} select request_id, status, case status when 400 then 'no log entries' when 404 then 'unknown project' when 403 then 'project inactive'
   when 401 then 'invalid ingest key' end as error, case when status = 201 then pid end as project_id, case when status = 201 then least(n, 500) end as charge from v""")
def admission(t):
    return ingest.admission(t.heavy.raw_requests(), t.projects()).select("request_id", "status", "error", "project_id", "charge")


@query("a30_admission_with_quota", f"""with recursive {_ADMISSION}, hits as (select request_id as hit_id, pid as key, epoch_ms(cast(received_at[1:23] as timestamp)) as ms, least(n, 500) as charge from v where status = 201),
  {_windows_sql(24 * HOUR)}, final as (select v.*, case when status = 201 and prior >= 200 then 429 else status end as s2 from v left join run on hit_id = request_id)
  select request_id, cast(s2 as integer) as status, case when s2 = 201 then stored end as stored, case when s2 = 201 then skipped end as skipped from final""")
def admission_with_quota(t):
    # parsed once; quota and settlement both read the outcome
    verdicts = cut(ingest.admission(t.heavy.raw_requests(), t.projects()))
    hits = verdicts.where("status = 201").select(F.col("request_id").alias("hit_id"), F.col("project_id").alias("key"),
                                                 F.unix_millis(times.event_ts(F.col("received_at"))).alias("ms"), F.col("charge").cast("bigint").alias("charge"))
    refused = quota.rate_limit(hits, 200, 24 * HOUR).where(~F.col("ok")).select(F.col("hit_id").alias("request_id"))
    return ingest.settle(verdicts, refused).select("request_id", "status", "stored", "skipped")


@query("a30_full_admission", f"""with recursive acc as ({_ACCOUNT_SQL}),
  base as (select r.request_id, a.n, a.stored, a.dropped, a.skipped, r.received_at, r.header_key, r.header_project, trim(string_split(r.forwarded_for, ',')[2]) as ip,
      case when r.request_id not like 'd%' then case when a.n = 0 then 400 end when cast(substring(r.request_id, 2) as bigint) % 499 = 0 then 413
        when a.n = 0 or cast(substring(r.request_id, 2) as bigint) % 83 = 0 then 400 end as early, epoch_ms(cast(received_at[1:23] as timestamp)) as ms
    from raw_requests r join acc a using (request_id)),
  hits1 as (select request_id as hit_id, 'ip:' || ip as key, ms, 1 as charge from base where early is null), {_windows_sql(6 * HOUR, "1")},
  v as (select b.*, p.id as pid, case when early is not null then early when prior >= 20 then 429 when p.id is null then 404 when p.is_active = false then 403
      when coalesce(p.ingest_key, '') = '' then 403 when coalesce(b.header_key, '') <> p.ingest_key then 401 else 201 end as status
    from base b left join run1 on hit_id = request_id
    left join projects p on (b.header_project is not null and p.id = b.header_project) or (b.header_project is null and p.ingest_key = b.header_key)),
  hits2 as (select request_id as hit_id, 'proj:' || pid as key, ms, least(n, 500) as charge from v where status = 201), {_windows_sql(24 * HOUR, "2")},
  done as (select v.*, case when status = 201 and prior >= 60 then 429 else status end as s2 from v left join run2 on hit_id = request_id)
  select request_id, cast(s2 as integer) as status, case s2 when 413 then 'payload too large' when 400 then 'no log entries' when 429 then 'rate limited' when 404 then 'unknown project'
      when 403 then 'project inactive' when 401 then 'invalid ingest key' end as error,
    case when s2 = 201 then pid end as project_id, case when s2 = 201 then stored end as stored, case when s2 = 201 then least(n, 500) end as charge from done""")
def full_admission(t):
    """Requests of every status: some documents come with blanks beyond the size limit or as an empty object, and both quotas are tight."""
    raw = t.heavy.raw_requests()
    number = F.when(F.col("request_id").startswith("d"), F.substring("request_id", 2, 20).cast("bigint"))
    raw = raw.withColumn("body", F.when(number % 499 == 0, F.concat("body", F.repeat(F.lit(" "), F.lit(ingest.MAX_BODY_BYTES)))).when(number % 83 == 0, "{}").otherwise(F.col("body")))
    ip = text.client_ip(F.col("forwarded_for"), F.col("real_ip"), F.col("direct_ip"))
    at = F.unix_millis(times.event_ts(F.col("received_at")))
    return ingest.admit(raw, t.projects(), ip, at, (20, 6 * HOUR), (60, 24 * HOUR)).select("request_id", "status", "error", "project_id", "stored", "charge")
