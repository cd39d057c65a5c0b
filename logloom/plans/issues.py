"""Issues, spikes, retention and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import alerts, fixwork, issues
from ..sources.tables import AS_OF
from .registry import query
from .sql_views import fingerprint_sql

_FP = fingerprint_sql("level", "channel", "message")
_SHAPED = f"shaped as (select *, {_FP} as fingerprint, timestamp || id as o from log_entries)"
_ROLLUP = f"""{_SHAPED}, issues as (select project_id, fingerprint, count(*) as events, min(timestamp) as first_seen, max(timestamp) as last_seen, arg_min(message, o) as title,
  arg_min(release, o) as first_release, arg_min(level, o) as level, (array_agg(channel order by o))[1] as channel, arg_min(environment, o) as environment,
  count(distinct json_extract_string(user_context, '$.id')) as users from shaped group by project_id, fingerprint)"""


@query("c01_issue_rollup", f"with {_ROLLUP} select project_id, fingerprint, events, first_seen, last_seen, title, level, channel, environment from issues")
def issue_rollup(t):
    return issues.issue_rollup(t.heavy.log_entries()).drop("first_release")


@query("c02_affected_users", f"with {_ROLLUP} select project_id, fingerprint, users from issues")
def affected_users(t):
    return issues.affected_users(t.heavy.log_entries())


@query("c03_top_issues", f"with {_ROLLUP} select project_id, fingerprint, events, title from issues order by events desc, project_id, fingerprint limit 10")
def top_issues(t):
    return issues.top_issues(issues.issue_rollup(t.heavy.log_entries())).select("project_id", "fingerprint", "events", "title")


@query("c04_new_and_regressed", f"""with {_SHAPED}, g as (select *, cast(substring(timestamp, 1, 23) as timestamp) as ts from shaped),
  l as (select *, epoch_us(ts) // 1000 - epoch_us(lag(ts) over (partition by project_id, fingerprint order by ts, id)) // 1000 as quiet_ms from g)
  select project_id, fingerprint, case when quiet_ms is null then 'new' else 'regression' end as moment, id as log_entry_id, timestamp as at, quiet_ms from l where quiet_ms is null or quiet_ms >= 3 * 86400000""")
def new_and_regressed(t):
    return issues.issue_moments(t.heavy.log_entries(), gap_days=3)


@query("c04_regression_after_resolved", f"""with {_SHAPED}, r as (select project_id, fingerprint, replace(min(created_at), ' ', 'T') || '.999Z' as resolved_at from fix_runs where status = 'completed' group by project_id, fingerprint)
  select s.project_id, s.fingerprint, arg_min(id, o) as log_entry_id, count(*) as events_since from shaped s join r using (project_id, fingerprint) where s.timestamp > r.resolved_at group by s.project_id, s.fingerprint""")
def regression_after_resolved(t):
    resolved = t.fix_runs().where("status = 'completed'").groupBy("project_id", "fingerprint").agg(
        F.concat(F.replace(F.min("created_at"), F.lit(" "), F.lit("T")), F.lit(".999Z")).alias("resolved_at"))
    return issues.regressions_after(t.heavy.log_entries(), resolved)


@query("c05_first_seen_release", f"with {_ROLLUP} select project_id, fingerprint, first_release from issues")
def first_seen_release(t):
    return issues.first_releases(t.heavy.log_entries())


@query("c06_spikes", """with c as (select project_id, epoch_us(cast(substring(timestamp, 1, 23) as timestamp)) // 3600000000 as hour, count(*) as events from log_entries group by all),
  g as (select project_id, unnest(generate_series(min(hour), max(hour))) as hour from c group by project_id),
  f as (select g.project_id, g.hour, coalesce(events, 0) as events from g left join c on c.project_id = g.project_id and c.hour = g.hour),
  w as (select *, count(*) over b as n, cast(sum(events) over b as bigint) as s, cast(sum(events * events) over b as bigint) as q from f window b as (partition by project_id order by hour rows between 24 preceding and 1 preceding)),
  m as (select *, s / n as mean, sqrt((n * q - s * s) / (n * n)) as deviation from w where n = 24)
  select project_id, strftime(make_timestamp(hour * 3600000000), '%Y-%m-%d %H:%M:%S') as hour, events, mean, deviation from m where events > mean + 3 * deviation and events >= 5""")
def spikes(t):
    return issues.spikes(t.log_entries(), floor=5)


@query("c07_environment_split", f"with {_SHAPED} select project_id, fingerprint, count(*) filter (where environment = 'production') as production, count(*) filter (where environment = 'staging') as staging from shaped group by project_id, fingerprint")
def environment_split(t):
    return issues.environment_split(t.heavy.log_entries(), ["production", "staging"])


@query("c08_retention", "select substring(timestamp, 1, 10) as day, count(*) as kept from log_entries where timestamp >= '2024-01-16T00:00:00.000Z' group by day")
def retention(t):
    return issues.retain(t.log_entries(), AS_OF, 15).groupBy(F.substring("timestamp", 1, 10).alias("day")).agg(F.count("*").alias("kept"))


@query("c09_severity_cube", "select project_id, environment, level, count(*) as events, cast(grouping(project_id, environment, level) as bigint) as grouping from log_entries group by cube (project_id, environment, level)")
def severity_cube(t):
    return issues.severity_cube(t.log_entries())


@query("c09_severity_rollup", "select project_id, environment, level, count(*) as events, cast(grouping(project_id, environment, level) as bigint) as grouping from log_entries group by rollup (project_id, environment, level)")
def severity_rollup(t):
    return issues.severity_rollup(t.log_entries())


# -- alerts ---------------------------------------------------------------------

_ALERTS = f"""{_ROLLUP}, al as (select i.project_id, p.name as project_name, fingerprint as issue_id, title, channel as culprit, level, case when environment <> 'staging' then environment end as environment,
    events as count, case when events > 50 then 'regression' else 'new' end as kind from issues i join projects p on p.id = i.project_id),
  fx as (select *, case kind when 'regression' then 'Regression' else 'New issue' end as heading, case kind when 'regression' then 'An issue you resolved is happening again.' else 'A new issue was just captured.' end as intro,
    'http://localhost:3000/issue/' || issue_id as url, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as etitle from al)"""


def _fact_sql(item, sep):
    def one(name, value, present):
        rendered = item.replace("NAME", name).replace("VALUE", f"' || {value} || '")
        if "INLINE" in rendered:
            rendered = rendered.replace("INLINE", "false" if name == "Where" else "true")
        return f"case when {present} then '{rendered}' end"
    parts = [one("Project", "project_name", "true"), one("Level", "level", "true"), one("Where", "culprit", "culprit is not null"),
             one("Environment", "environment", "environment is not null"), one("Occurrences", "count", "kind = 'regression'")]
    return f"concat_ws({sep}, {', '.join(parts)})"


def _alerts(t):
    p = t.projects().select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    rolled = issues.issue_rollup(t.heavy.log_entries()).join(p, "project_id")
    return rolled.select("project_id", "project_name", F.col("fingerprint").alias("issue_id"), "title", F.col("channel").alias("culprit"), "level",
                         F.when(F.col("environment") != "staging", F.col("environment")).alias("environment"), F.col("events").alias("count"),
                         F.when(F.col("events") > 50, "regression").otherwise("new").alias("kind"))


@query("a61_alert_facts", f"with {_ALERTS} select project_id, issue_id, {_fact_sql('NAME=VALUE', chr(39) + ';' + chr(39))} as facts from fx")
def alert_facts(t):
    joined = F.array_join(F.transform("facts", lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";")
    return alerts.render(_alerts(t)).select("project_id", "issue_id", joined.alias("facts"))


_SLACK_ITEM = '{"type":"mrkdwn","text":"*NAME*\\nVALUE"}'


@query("a62_slack_payload", f"""with {_ALERTS} select project_id, issue_id, '{{"text":"[logs] ' || heading || ' in ' || project_name || ': ' || title || '","blocks":[{{"type":"header","text":{{"type":"plain_text","text":"'
  || case kind when 'regression' then '🔁' else '🐛' end || ' ' || heading || '","emoji":true}}}},{{"type":"section","text":{{"type":"mrkdwn","text":"*<' || url || '|' || etitle || '>*\\n' || intro || '"}}}},{{"type":"section","fields":['
  || {_fact_sql(_SLACK_ITEM, "','")} || ']}},{{"type":"actions","elements":[{{"type":"button","text":{{"type":"plain_text","text":"Open in logs","emoji":true}},"url":"' || url || '","style":"danger"}}]}}]}}' as slack from fx""")
def slack_payload(t):
    return alerts.render(_alerts(t)).select("project_id", "issue_id", "slack")


_DISCORD_ITEM = '{"name":"NAME","value":"VALUE","inline":INLINE}'


@query("a63_discord_payload", f"""with {_ALERTS} select project_id, issue_id, '{{"embeds":[{{"title":"' || title || '","url":"' || url || '","description":"' || intro || '","color":' || case kind when 'regression' then 16096779 else 14753096 end
  || ',"fields":[' || {_fact_sql(_DISCORD_ITEM, "','")} || '],"footer":{{"text":"logs"}}}}]}}' as discord from fx""")
def discord_payload(t):
    return alerts.render(_alerts(t)).select("project_id", "issue_id", "discord")


@query("a64_email", f"""with {_ALERTS} select project_id, issue_id, '[logs] ' || heading || ' in ' || project_name || ': ' || title as subject,
  intro || chr(10) || chr(10) || title || chr(10) || {_fact_sql('NAME: VALUE', 'chr(10)')} || chr(10) || chr(10) || 'View it: ' || url as text, {_fact_sql('<tr><td>NAME</td><td>VALUE</td></tr>', "''")} as html_rows from fx""")
def email(t):
    return alerts.render(_alerts(t)).select("project_id", "issue_id", "subject", "text", "html_rows")


_VALID = r"""((c.type = 'slack' and regexp_matches(c.webhook_url, '^https://hooks\.slack\.com/services/')) or (c.type = 'discord'
   and regexp_matches(c.webhook_url, '^https://(discord\.com|discordapp\.com|canary\.discord\.com|ptb\.discord\.com)/api/(?:v\d+/)?webhooks/')))"""


@query("a30b_webhook_validity", f"select c.id, {_VALID} as ok, case when starts_with(webhook_url, 'http:') then 'Webhook URL must use https.' end as error from alert_channels c")
def webhook_validity(t):
    error = text.webhook_error(F.col("type"), F.col("webhook_url"))
    return t.alert_channels().select("id", error.isNull().alias("ok"), error.alias("error"))


_PLACES = f"""places as (select p.id as project_id, p.name as project_name, 'email' as via, u.email as target from projects p join users u on u.id = p.owner_id
    where not exists (select 1 from email_suppressions s where lower(s.email) = lower(u.email))
  union all select c.project_id, p.name, c.type, c.webhook_url from alert_channels c join projects p on p.id = c.project_id where c.enabled and {_VALID})"""


@query("a65_outbox", f"with {_ROLLUP}, {_PLACES} select i.project_id, i.fingerprint as issue_id, via, target, project_name from issues i join places using (project_id)")
def outbox(t):
    rolled = fixwork.with_fingerprint(t.heavy.log_entries()).select("project_id", F.col("fingerprint").alias("issue_id")).distinct()
    places = alerts.destinations(t.projects(), t.users(), t.alert_channels(), t.email_suppressions())
    return alerts.outbox(rolled, places)


@query("a67_suppression", "select id, email from users u where not exists (select 1 from email_suppressions s where s.type = 'complaint' and lower(s.email) = lower(u.email))")
def suppression(t):
    return alerts.drop_suppressed(t.users().select("id", "email"), t.email_suppressions(), ["complaint"])
