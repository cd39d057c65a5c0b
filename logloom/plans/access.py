"""Access joins, control lists and change data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, changes
from .registry import query

_PAIRS = """pairs as (
  select user_id, project_id, bool_or(is_owner) as is_owner from (
    select u.id as user_id, p.id as project_id, true as is_owner from users u join projects p on p.owner_id = u.id
    union all select u.id, m.project_id, false from users u join project_members m on lower(m.email) = lower(trim(u.email))
      join projects p on p.id = m.project_id) group by user_id, project_id)"""


def pairs(t):
    return access.access_pairs(t.users(), t.projects(), t.project_members())


@query("a31_access_semi_join", f"with {_PAIRS} select user_id, project_id, is_owner from pairs")
def access_semi_join(t):
    return pairs(t)


@query("a31_accessible_to_user", "select id, name from projects p where p.owner_id = 3 or exists (select 1 from project_members m where m.project_id = p.id and lower(m.email) = 'user3@example.com')")
def accessible_to_user(t):
    return access.accessible(t.projects(), 3, t.users(), t.project_members()).select("id", "name")


@query("a32_owner_only", "select u.id as user_id, p.id as project_id from users u join projects p on p.owner_id = u.id")
def owner_only(t):
    asks = t.users().select(F.col("id").alias("user_id"), F.explode(F.expr("transform(sequence(0, 4), i -> concat('proj-', i))")).alias("project_id"))
    return access.owned(t.projects(), asks)


@query("a33_entry_visibility", f"""with {_PAIRS} select e.user_id, l.id, l.project_id, l.message from events e
  join log_entries l on l.id = 'e' || e.event_id where exists (select 1 from pairs p where p.user_id = e.user_id and p.project_id = l.project_id)""")
def entry_visibility(t):
    asks = t.events.select("user_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"))
    return access.visible_entries(asks, t.log_entries().select("id", "project_id", "message"), pairs(t))


@query("a34_visible_projects", f"with {_PAIRS} select user_id, project_id, name, platform, created_at, is_active, is_owner from pairs join projects p on p.id = project_id")
def visible_projects(t):
    return access.visible_projects(t.projects(), pairs(t))


@query("a35_pending_invites", """select u.id as user_id, i.token, p.name as project_name, i.created_at from project_invites i
  join users u on lower(u.email) = lower(i.email) join projects p on p.id = i.project_id""")
def pending_invites(t):
    return access.pending_invites(t.project_invites(), t.users(), t.projects())


@query("a36_people", """select project_id, id, email, role, 'member' as kind, cast(null as boolean) as registered from project_members
  union all select i.project_id, i.id, i.email, null, 'invite', u.id is not null from project_invites i left join users u on lower(u.email) = lower(i.email)""")
def people(t):
    return access.people(t.project_members(), t.project_invites(), t.users())


@query("a37_enabled_channels", "select c.project_id, c.id, c.type, c.webhook_url, p.name as project_name from alert_channels c join projects p on p.id = c.project_id where c.enabled")
def enabled_channels(t):
    return access.enabled_channels(t.alert_channels(), t.projects())


@query("a38_owner_contacts", "select p.id as project_id, p.name as project_name, u.email from projects p join users u on u.id = p.owner_id")
def owner_contacts(t):
    return access.owner_contacts(t.projects(), t.users())


@query("a60_active_project", f"""with {_PAIRS} select user_id, project_id, is_owner from (
  select user_id, project_id, is_owner, row_number() over (partition by user_id order by (project_id = 'proj-' || (user_id % 7)) desc,
    (project_id = 'proj-' || (user_id % 3)) desc, created_at desc nulls last, project_id) as rn
  from pairs join projects p on p.id = project_id) where rn = 1""")
def active_project(t):
    uid = F.col("id")
    choices = t.users().select(uid.alias("user_id"), F.concat(F.lit("proj-"), (uid % 7).cast("string")).alias("requested"),
                               F.concat(F.lit("proj-"), (uid % 3).cast("string")).alias("remembered"))
    return access.active_project(access.visible_projects(t.projects(), pairs(t)), choices)


@query("a03c_upsert", """with target as (select c_custkey as project_key, 'acme' as owner, c_name as name, 'tok' || c_nationkey as token_hint, '2023-12-01 00:00:00' as created_at, '2023-12-01 00:00:00' as updated_at from customer),
  ch as (select user_id + 1400 as project_key, 'org' || event_type as owner, 'repo' || event_id as name, right('tok' || event_id, 4) as token_hint, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at,
     strftime(ts, '%Y-%m-%d %H:%M:%S') as updated_at, event_id from events),
  last as (select *, row_number() over (partition by project_key order by updated_at desc, event_id desc) as rn, first_value(created_at) over (partition by project_key order by updated_at, event_id) as first_created from ch)
  select coalesce(t.project_key, l.project_key) as project_key, coalesce(l.owner, t.owner) as owner, coalesce(l.name, t.name) as name, coalesce(l.token_hint, t.token_hint) as token_hint,
    coalesce(t.created_at, l.first_created) as created_at, coalesce(l.updated_at, t.updated_at) as updated_at
  from target t full join (select * from last where rn = 1) l on l.project_key = t.project_key""")
def upsert(t):
    early = F.lit("2023-12-01 00:00:00")
    target = t.customer.select(F.col("c_custkey").alias("project_key"), F.lit("acme").alias("owner"), F.col("c_name").alias("name"),
                               F.concat(F.lit("tok"), F.col("c_nationkey").cast("string")).alias("token_hint"),
                               early.alias("created_at"), early.alias("updated_at"))
    eid, at = F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    incoming = t.events.select((F.col("user_id") + 1400).alias("project_key"), F.concat(F.lit("org"), "event_type").alias("owner"),
                               F.concat(F.lit("repo"), eid).alias("name"), F.right(F.concat(F.lit("tok"), eid), F.lit(4)).alias("token_hint"),
                               at.alias("created_at"), at.alias("updated_at"), "event_id")
    return changes.upsert(target, incoming, "project_key", ["updated_at", "event_id"])


@query("a03d_cascading_delete", """with gone as (select id from projects where not is_active)
  select 'log_entries' as tbl, project_id, count(*) as rows from log_entries where project_id not in (select id from gone) group by project_id
  union all select 'alert_channels', project_id, count(*) from alert_channels where project_id not in (select id from gone) group by project_id
  union all select 'project_members', project_id, count(*) from project_members where project_id not in (select id from gone) group by project_id
  union all select 'project_invites', project_id, count(*) from project_invites where project_id not in (select id from gone) group by project_id
  union all select 'projects', id, count(*) from projects where id not in (select id from gone) group by id""")
def cascading_delete(t):
    gone = t.projects().where(~F.col("is_active"))
    tables = {"log_entries": t.log_entries(), "alert_channels": t.alert_channels(), "project_members": t.project_members(),
              "project_invites": t.project_invites(), "projects": t.projects().withColumn("project_id", F.col("id"))}
    out = None
    for name, table in tables.items():
        left = changes.delete_for(table, gone).groupBy("project_id").agg(F.count("*").alias("rows"))
        left = left.select(F.lit(name).alias("tbl"), "project_id", "rows")
        out = left if out is None else out.unionByName(left)
    return out


@query("a03e_predicate_update", "select id, case when enabled then 'old' else 'new' end as state, true as enabled, webhook_url from alert_channels")
def predicate_update(t):
    channels = t.alert_channels().withColumn("state", F.lit("old"))
    change = channels.where(~F.col("enabled")).select("id", F.lit(True).alias("enabled"), F.lit("new").alias("state"))
    return changes.update_by_key(channels, change, "id", ["enabled", "state"]).select("id", "state", "enabled", "webhook_url")


_SUBS = """ok as (select s.*, u.id as uid from subscription_events s left join users u on u.stripe_id = s.customer),
  w as (select *, row_number() over (partition by provider_id order by "at", event_id) as first_rn, row_number() over (partition by provider_id order by "at" desc, event_id desc) as last_rn
    from ok where kind <> 'deleted' and uid is not null),
  d as (select provider_id, "at", event_id, row_number() over (partition by provider_id order by "at" desc, event_id desc) as rn from ok where kind = 'deleted'),
  subs as (select f.provider_id, f.uid as user_id, 'default' as type, 'pro' as plan,
    case when (d."at", d.event_id) > (l."at", l.event_id) then 'canceled' else l.status end as provider_status, 'stripe' as provider_type,
    l.price_id as provider_price_id, l.unit_price, coalesce(f.quantity, 1) as quantity
  from w f join w l on l.provider_id = f.provider_id and l.last_rn = 1 left join d on d.provider_id = f.provider_id and d.rn = 1 where f.first_rn = 1)"""


@query("a68_subscription_sync", f"with {_SUBS} select * from subs")
def subscription_sync(t):
    return changes.sync_subscriptions(t.subscription_events(), t.users())


@query("a69_plan", f"with {_SUBS} select id as user_id, case when exists (select 1 from subs s where s.user_id = u.id and s.provider_status in ('active','trialing')) then 'pro' else 'free' end as plan from users u")
def plan(t):
    return changes.plans(t.users(), changes.sync_subscriptions(t.subscription_events(), t.users()))


_LOGINS = """logins as (select event_id, case when user_id % 2 = 0 then 'github' else 'google' end as provider, 's' || event_id as social_id,
    case when event_type = 'click' then '' else 'N' || user_id end as name,
    case when event_type = 'error' then '  ' when event_type = 'signup' then ' NEW' || (event_id % 3000) || '@Example.com' else 'USER' || (user_id * 20) || '@example.COM ' end as email,
    case when value > 50 then 'https://a/' || event_id end as avatar, event_type <> 'view' and event_id % 4 <> 0 as verified from events),
  valid as (select *, lower(trim(email)) as address from logins where trim(email) <> ''),
  known as (select lower(email) as address, id as user_id, name as user_name, avatar as user_avatar from users),
  j as (select v.*, k.user_id, k.user_name, k.user_avatar, row_number() over (partition by v.address order by event_id) as rn from valid v left join known k using (address)),
  acc as (select *, verified or (rn = 1 and user_id is null) as ok from j)"""


def _logins(t):
    uid, eid, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    return t.events.select(
        "event_id", F.when(uid % 2 == 0, "github").otherwise("google").alias("provider"),
        F.concat(F.lit("s"), eid.cast("string")).alias("social_id"),
        F.when(kind == "click", "").otherwise(F.concat(F.lit("N"), uid.cast("string"))).alias("name"),
        F.when(kind == "error", "  ").when(kind == "signup", F.concat(F.lit(" NEW"), (eid % 3000).cast("string"), F.lit("@Example.com")))
        .otherwise(F.concat(F.lit("USER"), (uid * 20).cast("string"), F.lit("@example.COM "))).alias("email"),
        F.when(F.col("value") > 50, F.concat(F.lit("https://a/"), eid.cast("string"))).alias("avatar"),
        ((kind != "view") & (eid % 4 != 0)).alias("verified"))


@query("a70_social_merge", f"""with {_LOGINS} select address, any_value(user_id) as user_id, case when any_value(user_id) is null then 'created' else 'linked' end as action,
  coalesce(any_value(user_name), nullif(arg_min(name, event_id), ''), split_part(address, '@', 1)) as name, arg_max(provider, event_id) as provider, arg_max(social_id, event_id) as social_id,
  coalesce(arg_max(avatar, event_id) filter (where avatar is not null), any_value(user_avatar)) as avatar from acc where ok group by address""")
def social_merge(t):
    return changes.merge_social(t.users(), _logins(t), ["event_id"])[0]


@query("a70_social_rejected", f"""with {_LOGINS} select social_id, 'no email' as reason from logins where trim(email) = ''
  union all select social_id, 'unverified email' from acc where not ok""")
def social_rejected(t):
    return changes.merge_social(t.users(), _logins(t), ["event_id"])[1]


_ATTEMPTS = """attempts as (select c_custkey as user_id, case c_mktsegment when 'HOUSEHOLD' then md5('inv_' || (c_custkey + 1)) when 'AUTOMOBILE' then '' else md5('inv_' || c_custkey) end as token from customer),
  v as (select a.user_id, a.token, i.id as invite_id, i.project_id, lower(u.email) as address,
    cast(case when a.token = '' then 400 when i.id is null then 404 when lower(i.email) <> lower(u.email) then 403 else 200 end as integer) as status
    from attempts a join users u on u.id = a.user_id left join project_invites i on i.token = a.token)"""


def _verdicts(t):
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    attempts = t.customer.select(key.alias("user_id"), F.when(seg == "HOUSEHOLD", F.md5(F.concat(F.lit("inv_"), (key + 1).cast("string"))))
                                 .when(seg == "AUTOMOBILE", "").otherwise(F.md5(F.concat(F.lit("inv_"), key.cast("string")))).alias("token"))
    return changes.accept_invites(t.project_invites(), t.project_members(), t.users(), attempts)


@query("a71_invite_verdicts", f"with {_ATTEMPTS} select user_id, token, invite_id, project_id, address, status from v")
def invite_verdicts(t):
    return _verdicts(t)


@query("a71_after_acceptance", f"""with {_ATTEMPTS}, done as (select * from v where status = 200)
  select 'member' as kind, project_id, lower(email) as email from project_members union all
  select 'member', project_id, address from (select distinct project_id, address from done) n where not exists (select 1 from project_members m where m.project_id = n.project_id and lower(m.email) = n.address)
  union all select 'invite', project_id, lower(email) from project_invites where id not in (select invite_id from done)""")
def after_acceptance(t):
    members, invites = changes.after_acceptance(_verdicts(t), t.project_members(), t.project_invites())
    return members.select(F.lit("member").alias("kind"), "project_id", F.lower("email").alias("email")).unionByName(
        invites.select(F.lit("invite").alias("kind"), "project_id", F.lower("email").alias("email")))
