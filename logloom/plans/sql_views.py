"""The derived views of ``sources.tables`` as plain SQL over the given tables."""

from __future__ import annotations

_B = r"\b"

# Same masks as functions.fingerprint; this dialect's \b is ASCII already.
# The masks of a message shape, in their order.
_MASKS = [
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}(?:\.\d+)?z?\b", "<time>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "<date>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>"),
    (r"\b[\w.%+-]+@[\w.-]+\.[a-z]{2,}\b", "<email>"),
    (r"\b[0-9a-f]{12,}\b", "<hex>"),
    (r"\b[a-z][a-z0-9]*_[a-z0-9]{4,}\b", "<id>"),
    (r"\d{2,}", "<n>"),
    (r"\b\d\b", "<n>"),
]


def shape_sql(message: str) -> str:
    text = f"lower(substring(coalesce({message}, ''), 1, 2000))"
    for pattern, label in _MASKS:
        text = f"regexp_replace({text}, '{pattern}', '{label}', 'g')"
    return f"trim(regexp_replace({text}, '[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'))"


def fingerprint_sql(level: str, channel: str, message: str) -> str:
    return (f"substring(sha256(lower(coalesce({level}, 'info')) || chr(0) || lower(coalesce({channel}, '')) "
            f"|| chr(0) || {shape_sql(message)}), 1, 40)")


# Dependencies first.
VIEWS: dict[str, str] = {
    "log_entries": """
select 'e' || event_id as id,
  'proj-' || (user_id % 5) as project_id,
  case event_type
    when 'error' then case event_id % 4 when 0 then 'error' when 1 then 'critical' when 2 then 'alert' else 'emergency' end
    when 'purchase' then 'warning' when 'signup' then 'notice' when 'click' then 'info' else 'debug' end as level,
  case event_type
    when 'error' then 'charge for sub_' || (10000 + event_id) || ' declined after ' || k || ' retries'
    when 'purchase' then 'order ' || event_id || ' paid by User' || user_id || '@Example.com'
    when 'signup' then 'timeout connecting to 10.0.' || (user_id % 256) || '.' || k || ':5432'
    when 'click' then 'GET /api/orders/' || event_id || ' took ' || k || 'ms'
    else 'cache warm' end as message,
  case user_id % 4 when 0 then 'billing' when 1 then 'queue' when 2 then 'http' else null end as channel,
  case when user_id % 10 = 0 then 'staging' else 'production' end as environment,
  'app@2.' || cast(floor((day(ts) - 1) / 7) as integer) as release,
  cast(null as varchar) as framework,
  'host-' || (user_id % 3) as host,
  cast(null as varchar) as sdk,
  props as context, '{"id":' || user_id || '}' as user_context,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as timestamp,
  case when event_id % 3 = 0 then md5(user_id || '/' || day(ts)) end as trace_id,
  case when event_id % 5 = 0 then 'req-' || cast(floor(event_id / 10) as bigint) end as request_id
from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)""",
    "raw_requests": """
select request_id, body, header_project,
  case when n % 11 = 0 then null when n % 11 = 1 then 'key_wrong'
    else 'key_' || md5(['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'][cast(substring(project, 6, 1) as integer) + 1]) end as header_key,
  '203.0.113.' || (n % 50) || ', 10.0.0.' || (n % 9) as forwarded_for,
  '192.0.2.1' as real_ip, '192.0.2.2' as direct_ip, received_at
from (
  select *, coalesce(header_project, 'proj-' || (n % 5)) as project from (
    select 'b' || b as request_id, '{"logs":[' || string_agg(e, ',' order by event_id) || ']}' as body,
      'proj-' || (min(user_id) % 6) as header_project, min(user_id) as n, min(received_at) as received_at
    from (
      select event_id // 4 as b, event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as received_at,
        case event_id % 7 when 0 then 'null' when 1 then '{}' when 2 then '5'
          when 3 then '{"message":"m' || event_id || '","level":"ERROR","traceId":"t' || user_id || '"}'
          when 4 then '{"message":' || event_id || ',"level":"error","user":{"id":' || user_id || '}}'
          else '{"message":"m' || event_id || '","level":"warning","context":{"k":1,"user":{"id":' || user_id || '}}}' end as e
      from events) group by b
    union all
    select 'd' || doc_id, cast(to_json({'message': text, 'channel': source, 'context': {'lang': lang, 'n_chars': n_chars},
        'timestamp': '2024-01-15T08:00:00.000Z'}) as varchar),
      null, doc_id, '2024-01-15T08:00:01.000Z' from documents))""",
    "projects": """
select 'proj-' || r_regionkey as id, r_name as name, 'javascript' as platform, 'key_' || md5(r_name) as ingest_key,
  cast(r_regionkey + 1 as bigint) as owner_id, r_regionkey <> 4 as is_active,
  case when r_regionkey <> 3 then '2024-01-0' || (r_regionkey + 1) || ' 00:00:00' end as created_at from region""",
    "users": """
select c_custkey as id, c_name as name, 'User' || c_custkey || '@Example.com' as email,
  'cus_' || substring(md5(c_name), 1, 14) as stripe_id,
  case when c_acctbal < 0 then 'https://img.example.com/' || c_custkey end as avatar from customer""",
    "project_members": """
select 'mem_' || c_custkey as id, 'proj-' || (c_custkey % 5) as project_id,
  case when c_custkey % 2 = 0 then lower('User' || c_custkey || '@Example.com') else upper('User' || c_custkey || '@Example.com') end as email,
  case when c_nationkey > 3 then '2024-01-' || lpad(cast(c_nationkey as varchar), 2, '0') || ' 00:00:00' end as created_at,
  'member' as role from customer where c_mktsegment = 'BUILDING'""",
    "project_invites": """
select 'inv_' || c_custkey as id, 'proj-' || (c_custkey % 5) as project_id,
  case when c_nationkey <= 3 then 'guest' || c_custkey || '@example.org'
    when c_custkey % 2 = 0 then lower('User' || c_custkey || '@Example.com') else upper('User' || c_custkey || '@Example.com') end as email,
  case when c_nationkey > 3 then '2024-01-' || lpad(cast(c_nationkey as varchar), 2, '0') || ' 00:00:00' end as created_at,
  md5('inv_' || c_custkey) as token from customer where c_mktsegment = 'MACHINERY'""",
    "alert_channels": """
select 'ch_' || n_nationkey as id, 'proj-' || n_regionkey as project_id,
  case when n_nationkey % 2 = 0 then 'slack' else 'discord' end as type,
  case when n_nationkey % 5 = 4 then 'http://intranet.example.com/x'
    when n_nationkey % 2 = 0 then 'https://hooks.slack.com/services/' || n_name
    else 'https://discord.com/api/webhooks/' || n_name end as webhook_url,
  n_nationkey % 3 <> 0 as enabled from nation""",
    "email_suppressions": """
select upper('User' || c_custkey || '@Example.com') as email,
  case when c_acctbal < -500 then 'complaint' else 'bounce' end as type from customer where c_acctbal < 0""",
    "fix_runs": f"""
select 'run_' || id as id, project_id, id as log_entry_id, {fingerprint_sql('level', 'channel', 'message')} as fingerprint,
  case when st = 0 then 'queued' when st = 1 then 'running' when st <= 3 then 'failed' else 'completed' end as status,
  replace(substring(timestamp, 1, 19), 'T', ' ') as created_at,
  case when st = 7 then 'not json' when st > 3 then '{{"summary":"s ' || id || '","rootCause":"r","confidence":"low","suspects":[{{"location":"a.b","reason":"x"}}],'
    || '"steps":[{{"title":"t","detail":"d"}},{{"title":"t2","detail":"d2"}}],"patch":"","verification":["v1","v2"]}}' end as analysis
from (select *, cast('0x' || substring(md5(id), 1, 2) as integer) % 8 as st from log_entries)
where level in ('warning', 'error', 'critical', 'alert', 'emergency')""",
    "run_events": """
select 'run_' || (event_id // 5) as run_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as at,
  case event_type when 'signup' then 'queued' when 'error' then 'failed' when 'purchase' then 'completed' else 'running' end as kind
from events""",
    "subscription_events": """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as at, 'sub_' || user_id as provider_id,
  case when user_id % 13 = 0 then 'cus_unknown'
    else 'cus_' || substring(md5('Customer#' || lpad(cast(user_id as varchar), 9, '0')), 1, 14) end as customer,
  case event_type when 'signup' then 'created' when 'error' then 'deleted' else 'updated' end as kind,
  case event_type when 'purchase' then 'active' when 'click' then 'past_due' else 'trialing' end as status,
  'price_' || (event_id % 3) as price_id, cast(floor(value * 100) as bigint) as unit_price,
  case when event_id % 4 <> 0 then cast(event_id % 4 as integer) end as quantity from events""",
    "query_logs": """
select 'q' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id,
  case when l_linestatus = 'O' then 'select * from orders where id = ' || l_orderkey || ' and flag = ''' || l_returnflag || ''''
    else 'UPDATE parts SET qty = ' || cast(l_quantity as integer) || ' WHERE id IN (' || l_partkey || ', ' || l_suppkey || ')' end as query,
  l_quantity * 4 as duration, case when l_linestatus = 'O' then 'primary' else 'replica' end as connection,
  case when l_returnflag = 'R' then 'boom' end as error,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as executed_at, cast(l_orderkey as varchar) as transaction_id from lineitem""",
}
