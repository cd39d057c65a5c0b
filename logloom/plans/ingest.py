"""Ingest shaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels, text, times
from ..functions.display import pretty_json
from ..operators import fixwork, ingest, issues, stream_query
from ..sources import io
from ..sources.tables import AS_OF
from ..streaming.jobs import shared_folder
from .registry import query

_ENTRIES = """
entries as (
  select request_id, header_project, received_at, cast(pos as integer) as pos, e from (
    select request_id, header_project, received_at, unnest(range(len(arr))) as pos, unnest(arr) as e from (
      select *, case when json_type(body, '$.logs') = 'ARRAY' then json_extract(body, '$.logs[*]')
        when json_type(body, '$.message') is not null and json_type(body, '$.message') <> 'NULL' then [cast(body as json)]
        else [] end as arr from raw_requests)))"""
_USABLE = "(json_type(e) = 'OBJECT' and coalesce(json_type(e, '$.message'), 'NULL') <> 'NULL')"


_RAW_SQL = "select request_id, header_key, header_project, received_at, cast(octet_length(encode(body)) as integer) as bytes from raw_requests"


@query("a01_raw_ingest", _RAW_SQL)
def raw_ingest(t):
    return t.raw_requests().select("request_id", "header_key", "header_project", "received_at", F.octet_length("body").alias("bytes"))


@query("a02_extract_entries", f"with {_ENTRIES} select request_id, pos, {_USABLE} as usable, json_extract_string(e, '$.message') as message from entries")
def extract_entries(t):
    return ingest.extract_entries(t.heavy.raw_requests()).select(
        "request_id", "pos", "usable", F.when(F.col("usable"), F.get_json_object("text", "$.message")).alias("message"))


def _clip_sql(col, n):
    return f"case when length({col}) > {n} then substring({col}, 1, {n}) || '…[truncated]' else {col} end"


def _varchar_sql(col, n):
    return f"case when length({col}) > {n} then substring({col}, 1, {n - 1}) || '…' else {col} end"


@query("a04_clip", f"select doc_id, {_clip_sql('text', 16384)} as message from documents")
def clip(t):
    return t.documents.select("doc_id", text.clip(F.col("text"), text.MAX_MESSAGE).alias("message"))


@query("a05_varchar_col", f"select doc_id, {_varchar_sql('text', 100)} as short from documents")
def varchar_col(t):
    return t.documents.select("doc_id", text.varchar(F.col("text"), 100).alias("short"))


@query("a06_col255_col64", f"select conv_id, turn, {_varchar_sql('text', 255)} as c255, {_varchar_sql('text', 64)} as c64 from conversations")
def col255_col64(t):
    return t.conversations.select("conv_id", "turn", text.col255(F.col("text")).alias("c255"), text.col64(F.col("text")).alias("c64"))


_JSON_COL = """case when json_type(e, '$.{0}') in ('OBJECT','ARRAY') and cast(json_extract(e, '$.{0}') as varchar) not in ('{{}}','[]')
  then case when length(cast(json_extract(e, '$.{0}') as varchar)) > {1} then '{{"_truncated":"oversized context dropped"}}' else cast(json_extract(e, '$.{0}') as varchar) end end"""


@query("a07_json_column", f"with {_ENTRIES} select request_id, pos, {_JSON_COL.format('context', 98304)} as context, {_JSON_COL.format('user', 98304)} as usr from entries")
def json_column(t):
    e = ingest.extract_entries(t.heavy.raw_requests())
    raw = F.from_json("text", "context string, user string")
    context, user = (F.try_variant_get("node", p, "variant") for p in ("$.context", "$.user"))
    return e.select("request_id", "pos", ingest.json_text(context, raw["context"]).alias("context"),
                    ingest.json_text(user, raw["user"]).alias("usr"))


_LEVEL_SQL = "case when {0} in ('debug','info','notice','warning','error','critical','alert','emergency') then {0} else 'info' end"


@query("a08_normalize_level", f"select event_id, {_LEVEL_SQL.format('event_type')} as level, {_LEVEL_SQL.format('upper(event_type)')} as shouted from events")
def normalize_level(t):
    kind = F.col("event_type")
    return t.events.select("event_id", levels.normalize_level(kind).alias("level"), levels.normalize_level(F.upper(kind)).alias("shouted"))


_USER_SQL = """case when coalesce(json_type(e, '$.user'), 'NULL') <> 'NULL'
    then case when json_type(e, '$.user') in ('OBJECT','ARRAY') then nullif(nullif(cast(json_extract(e, '$.user') as varchar), '{}'), '[]') end
  when json_type(e, '$.context.user') in ('OBJECT','ARRAY') then nullif(nullif(cast(json_extract(e, '$.context.user') as varchar), '{}'), '[]') end"""

_ROWS_SQL = f"""
select substring(sha256(request_id || '|' || pos), 1, 36) as id, header_project as project_id,
  {_LEVEL_SQL.format("coalesce(json_extract_string(e, '$.level'), '')")} as level,
  {_clip_sql("json_extract_string(e, '$.message')", 16384)} as message,
  {_varchar_sql("json_extract_string(e, '$.channel')", 255)} as channel,
  {_JSON_COL.format('context', 98304)} as context,
  coalesce({_varchar_sql("json_extract_string(e, '$.environment')", 255)}, 'production') as environment,
  json_extract_string(e, '$.release') as release, json_extract_string(e, '$.framework') as framework,
  json_extract_string(e, '$.host') as host, {_JSON_COL.format('sdk', 4096)} as sdk,
  {_USER_SQL} as user_context,
  coalesce(json_extract_string(e, '$.timestamp'), received_at) as timestamp,
  coalesce(json_extract_string(e, '$.trace_id'), json_extract_string(e, '$.traceId')) as trace_id,
  coalesce(json_extract_string(e, '$.request_id'), json_extract_string(e, '$.requestId')) as request_id
from entries where {_USABLE} and pos < 500"""


def _column_query(name, columns):
    picked = ", ".join(columns)

    @query(name, f"with {_ENTRIES} select id, {picked} from ({_ROWS_SQL})")
    def run(t):
        return ingest.normalize_requests(t.heavy.raw_requests()).select("id", *columns)

    return run


user_extraction = _column_query("a09_user_extraction", ["user_context"])
alias_coalescing = _column_query("a10_alias_coalescing", ["trace_id", "request_id"])
defaults = _column_query("a11_defaults", ["environment", "timestamp"])


@query("a12_normalize_entry", f"with {_ENTRIES} {_ROWS_SQL}")
def normalize_entry(t):
    return ingest.normalize_requests(t.heavy.raw_requests())


_ACCOUNT_SQL = f"""with {_ENTRIES}, per as (
  select request_id, cast(count(*) as integer) as n, cast(count(*) filter (where {_USABLE} and pos < 500) as integer) as stored,
    cast(greatest(0, count(*) - 500) as integer) as dropped from entries group by request_id)
select r.request_id, coalesce(n, 0) as n, coalesce(stored, 0) as stored, coalesce(dropped, 0) as dropped,
  coalesce(n - stored - dropped, 0) as skipped from raw_requests r left join per using (request_id)"""


@query("a13_normalize_batch_accounting", _ACCOUNT_SQL)
def batch_accounting(t):
    return ingest.accounting(t.heavy.raw_requests()).select("request_id", "n", "stored", "dropped", "skipped")


@query("a57_ingest_totals", f"""select header_project, count(*) as requests, cast(sum(n) as bigint) as n, cast(sum(stored) as bigint) as stored,
  cast(sum(dropped) as bigint) as dropped, cast(sum(skipped) as bigint) as skipped
  from ({_ACCOUNT_SQL}) a join raw_requests r using (request_id) group by header_project""")
def ingest_totals(t):
    sums = [F.sum(c).alias(c) for c in ("n", "stored", "dropped", "skipped")]
    return ingest.accounting(t.heavy.raw_requests()).groupBy("header_project").agg(F.count("*").alias("requests"), *sums)


@query("a14_row_id", f"with {_ENTRIES} select count(*) as rows, count(distinct id) as ids, min(id) as first_id, max(id) as last_id from ({_ROWS_SQL})")
def row_id(t):
    return ingest.normalize_requests(t.heavy.raw_requests()).agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("a02_quarantine", """with bodies as (
    select request_id, body from raw_requests union all select 'p' || page_id, html from pages union all select 'e' || event_id, props from events)
  select request_id, case when not json_valid(body) then 'malformed' else 'no log entries' end as reason from bodies
  where not json_valid(body) or (coalesce(json_type(case when json_valid(body) then body end, '$.logs'), '') <> 'ARRAY'
    and coalesce(json_type(case when json_valid(body) then body end, '$.message'), 'NULL') = 'NULL')""")
def quarantine(t):
    bodies = (
        t.raw_requests().select("request_id", "body")
        .unionByName(t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("request_id"), F.col("html").alias("body")))
        .unionByName(t.events.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"), F.col("props").alias("body"))))
    return ingest.quarantine(bodies).select("request_id", "reason")


@query("a15_severity_labels", """select id, case level when 'emergency' then 'EMERG' when 'critical' then 'CRIT' when 'warning' then 'WARN' when 'notice' then 'NOTE' else upper(level) end as chip,
  upper(level) as label, level as key, cast(list_position(['debug','info','notice','warning','error','critical','alert','emergency'], level) - 1 as integer) as severity from log_entries""")
def severity_labels(t):
    level = F.col("level")
    return t.log_entries().select("id", levels.chip_label(level).alias("chip"), levels.level_label(level).alias("label"),
                                  levels.level_key(level).alias("key"), levels.severity(level).alias("severity"))


@query("a16_time_labels", """select id, substring(timestamp, 12, 8) as clock, substring(timestamp, 6, 5) as day,
  replace(substring(timestamp, 1, 19), 'T', ' ') as stamp from log_entries""")
def time_labels(t):
    ts = F.col("timestamp")
    return t.log_entries().select("id", times.clock(ts).alias("clock"), times.day(ts).alias("day"),
                                  times.utc_stamp(times.event_ts(ts)).alias("stamp"))


@query("a17_utc_stamps", """select count(*) as n, '2024-01-31 00:00:00' as now_stamp, '2024-01-29 00:00:00' as ago_48h
  from log_entries where replace(substring(timestamp, 1, 19), 'T', ' ') > '2024-01-29 00:00:00'""")
def utc_stamps(t):
    now = times.as_instant(AS_OF)
    stamp = times.utc_stamp(times.event_ts(F.col("timestamp")))
    return (t.log_entries().where(stamp > times.utc_hours_ago(AS_OF, 48)).agg(F.count("*").alias("n"))
            .withColumn("now_stamp", times.utc_stamp(now)).withColumn("ago_48h", times.utc_hours_ago(AS_OF, 48)))


@query("a18_relative_time", """select id, case when s < 60 then 'just now' when s < 3600 then (s // 60) || 'm ago'
  when s < 86400 then (s // 3600) || 'h ago' else (s // 86400) || 'd ago' end as ago
  from (select id, greatest(0, cast(epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(cast(substring(timestamp, 1, 23) as timestamp))) as bigint)) as s from log_entries)""")
def relative_time(t):
    return t.log_entries().select("id", times.relative(times.event_ts(F.col("timestamp")), AS_OF).alias("ago"))


@query("a19_json_display", """select id, coalesce(shown, '') as shown from (select id, '{' || chr(10) || array_to_string(list_transform(json_keys(c), lambda k: '  "' || k || '": ' || case json_type(c, '$.' || k) when 'OBJECT' then
    '{' || chr(10) || array_to_string(list_transform(json_keys(c, '$.' || k), lambda m: '    "' || m || '": ' || cast(json_extract(c, '$.' || k || '.' || m) as varchar)), ',' || chr(10)) || chr(10) || '  }'
    else cast(json_extract(c, '$.' || k) as varchar) end), ',' || chr(10)) || chr(10) || '}' as shown
  from (select id, cast('{"z":' || context || ',"user":' || user_context || ',"level":"' || level || '","a":null}' as json) as c from log_entries))""")
def json_display(t):
    """Context and user of every entry in one object, keys in their order."""
    both = F.concat(F.lit('{"z":'), "context", F.lit(',"user":'), "user_context", F.lit(',"level":"'), "level", F.lit('","a":null}'))
    return t.log_entries().select("id", pretty_json(both).alias("shown"))


@query("a20_secret_masking", """select c.id, regexp_extract(webhook_url, '^https?://([^/]+)', 1) || '/…' || right(webhook_url, 4) as webhook,
  substring(p.ingest_key, 1, 10) || '……' || right(p.ingest_key, 4) as key, right(p.ingest_key, 4) as hint
  from alert_channels c join projects p on p.id = c.project_id""")
def secret_masking(t):
    p = t.projects().select(F.col("id").alias("project_id"), "ingest_key")
    return t.alert_channels().join(p, "project_id").select(
        "id", text.mask_webhook(F.col("webhook_url")).alias("webhook"), text.mask_key(F.col("ingest_key")).alias("key"),
        text.token_hint(F.col("ingest_key")).alias("hint"))


@query("a21_project_slug", """select p_partkey, case when s = '' then 'app' else s end || '-' || substring(sha256(cast(p_partkey as varchar)), 1, 6) as slug
  from (select p_partkey, substring(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '! ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24) as s from part)""")
def project_slug(t):
    name = F.concat("p_name", F.lit(" / "), "p_type", F.lit("! "), "p_brand")
    return t.part.select("p_partkey", text.project_slug_id(name, F.col("p_partkey")).alias("slug"))


@query("a22_repository_ref", r"""select page_id, case when ok then list_extract(parts, 1) end as owner, case when ok then list_extract(parts, 2) end as name from (
  select page_id, parts, coalesce(len(parts) >= 2 and regexp_full_match(parts[1], '[A-Za-z0-9_.-]+') and regexp_full_match(parts[2], '[A-Za-z0-9_.-]+')
    and not regexp_full_match(parts[1], '\.+') and not regexp_full_match(parts[2], '\.+'), false) as ok
  from (select page_id, list_filter(string_split(regexp_replace(replace(url, regexp_extract(url, '^http://[^/]+'), 'https://github.com'), '^https://github.com/', ''), '/'), lambda x: x <> '') as parts from pages))""")
def repository_ref(t):
    url = F.regexp_replace("url", "^http://[^/]+", "https://github.com")
    ref = text.repository_ref(url)
    return t.pages.select("page_id", ref["owner"].alias("owner"), ref["name"].alias("name"))


@query("a23_client_ip", "select request_id, trim(string_split(forwarded_for, ',')[2]) as ip, trim(string_split(forwarded_for, ',')[1]) as ip_two_hops, real_ip as ip_untrusted from raw_requests")
def client_ip(t):
    args = F.col("forwarded_for"), F.col("real_ip"), F.col("direct_ip")
    return t.raw_requests().select("request_id", text.client_ip(*args).alias("ip"), text.client_ip(*args, trusted_hops=5).alias("ip_two_hops"),
                                   text.client_ip(*args, trusted_hops=0).alias("ip_untrusted"))


@query("a24_escaping", """select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as html,
  replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as chat from pages""")
def escaping(t):
    return t.pages.select("page_id", text.escape_html(F.col("html")).alias("html"), text.escape_chat(F.col("html")).alias("chat"))


@query("a25_email_shape", r"""select c_custkey, lower(trim(e)) as email, regexp_full_match(lower(trim(e)), '[^\s@]+@[^\s@]+\.[^\s@]+') and length(trim(e)) <= 255 as ok
  from (select c_custkey, case c_mktsegment when 'BUILDING' then '  User' || c_custkey || '@Example.com ' when 'MACHINERY' then 'no-at-sign.example' when 'HOUSEHOLD' then 'a@b@' || c_custkey || '.com' else c_name || '@Host' || '.org' end as e from customer)""")
def email_shape(t):
    key, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    raw = (F.when(seg == "BUILDING", F.concat(F.lit("  User"), key, F.lit("@Example.com "))).when(seg == "MACHINERY", "no-at-sign.example")
           .when(seg == "HOUSEHOLD", F.concat(F.lit("a@b@"), key, F.lit(".com"))).otherwise(F.concat("c_name", F.lit("@Host.org"))))
    return t.customer.select("c_custkey", text.canonical_email(raw).alias("email"), text.email_ok(raw).alias("ok"))


@query("a26_absolute_url", r"""select page_id, case when regexp_matches(u, '^https?://') then u else 'http://localhost:3000' end as url
  from (select page_id, regexp_replace(case when length(url) % 3 = 0 then replace(url, 'http://', '') when length(url) % 3 = 1 then url || '/' else url end, '/$', '') as u from pages)""")
def absolute_url(t):
    n, url = F.length("url"), F.col("url")
    raw = F.when(n % 3 == 0, F.replace(url, F.lit("http://"), F.lit(""))).when(n % 3 == 1, F.concat(url, F.lit("/"))).otherwise(url)
    return t.pages.select("page_id", text.absolute_url(raw, F.lit("http://localhost:3000")).alias("url"))



@query("a03_append_sink", "select project_id, substring(timestamp, 1, 10) as event_date, 2 * count(*) as rows, count(distinct id) as ids from log_entries group by all")
def append_sink(t):
    # appended twice: the log never collapses repeats
    folder = shared_folder(t.spark, "log")
    for _ in range(2):
        io.append_entries(t.log_entries(), folder)
    back = io.read_entries(t.spark, folder)
    return back.groupBy("project_id", "event_date").agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query("a01_request_files", _RAW_SQL)
def request_files(t):
    # half of the requests come as JSON files, half as Parquet
    folder, raw = shared_folder(t.spark, "requests"), t.raw_requests()
    odd = F.pmod(F.xxhash64("request_id"), F.lit(2)) == 1
    raw.where(odd).write.json(f"{folder}/json")
    raw.where(~odd).write.parquet(f"{folder}/parquet")
    read = io.read_raw(t.spark, f"{folder}/json", "json").unionByName(io.read_raw(t.spark, f"{folder}/parquet"))
    return read.select("request_id", "header_key", "header_project", "received_at", F.octet_length("body").alias("bytes"))


@query("a01_body_lines", """select cast(octet_length(encode(body)) as integer) as bytes, 3 * count(*) as bodies, 3 * count(*) as ids, cast(count(distinct body) as bigint) as contents from raw_requests group by bytes""")
def body_lines(t):
    # every body stands three times in the files; each line is a request of its own
    folder = shared_folder(t.spark, "bodies")
    t.raw_requests().select(F.explode(F.array_repeat("body", 3)).alias("value")).write.text(folder)
    return io.read_bodies(t.spark, folder).groupBy(F.octet_length("body").alias("bytes")).agg(
        F.count("*").alias("bodies"), F.count_distinct("request_id").alias("ids"), F.count_distinct("body").alias("contents"))


def _written(t):
    folder = shared_folder(t.spark, "log")
    io.append_entries(t.log_entries(), folder)
    return io.read_entries(t.spark, folder)


@query("a28_written_log_ranges", """select '24h' as range, project_id, event_date, count(*) as n from (select *, substring(timestamp, 1, 10) as event_date from log_entries) where timestamp >= '2024-01-30T00:00:00.000Z' group by project_id, event_date
  union all select '7d', project_id, event_date, count(*) from (select *, substring(timestamp, 1, 10) as event_date from log_entries) where timestamp >= '2024-01-24T00:00:00.000Z' group by project_id, event_date""")
def written_log_ranges(t):
    """Time ranges on the written log read its days only."""
    log, out = _written(t), None
    for key in ("24h", "7d"):
        part = stream_query.in_range(log, key, AS_OF).groupBy("project_id", "event_date").agg(F.count("*").alias("n")).select(F.lit(key).alias("range"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("a51_written_log_occurrences", """select e.id, coalesce(n, 0) as occurrences, cast(k.kept as bigint) as kept from log_entries e left join (select project_id, message, count(*) as n
  from log_entries where timestamp > '2024-01-24T00:00:00.000Z' group by project_id, message) c on c.project_id = e.project_id and c.message = e.message,
  (select count(*) as kept from log_entries where timestamp >= '2024-01-16T00:00:00.000Z') k""")
def written_log_occurrences(t):
    """Recent occurrences of every entry, and the rows that retention keeps, from the written log."""
    log = _written(t)
    kept = issues.retain(log, AS_OF, 15).agg(F.count("*").alias("kept"))
    return fixwork.recent_occurrences(t.log_entries(), log, AS_OF).select("id", "occurrences").withColumn("one", F.lit(1)).join(kept.withColumn("one", F.lit(1)), "one").drop("one")
