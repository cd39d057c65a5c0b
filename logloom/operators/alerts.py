"""Alert texts, payloads and the outbox they are sent from. Sending is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .access import enabled_channels, owner_contacts
from .skew import salted_join

APP_NAME = "logs"
BASE_URL = "http://localhost:3000"

# Embed colours and the wording of the two alert kinds.
COLORS = {"new": 0xE11D48, "regression": 0xF59E0B}
HEADINGS = {"new": "New issue", "regression": "Regression"}
INTROS = {"new": "A new issue was just captured.", "regression": "An issue you resolved is happening again."}
EMOJI = {"new": "🐛", "regression": "🔁"}


def _by_kind(values: dict) -> Column:
    return F.when(F.col("kind") == "regression", F.lit(values["regression"])).otherwise(F.lit(values["new"]))


def _given(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(column))


def issue_url(base: str = BASE_URL) -> Column:
    missing = F.coalesce(F.col("issue_id"), F.lit("")).isin("", "test")
    return F.when(missing, F.lit(f"{base}/dashboard")).otherwise(F.concat(F.lit(f"{base}/issue/"), "issue_id"))


def facts() -> Column:
    """Ordered (name, value) pairs; absent ones are left out, occurrences only for regressions."""
    again = (F.col("kind") == "regression") & (F.coalesce(F.col("count"), F.lit(0)) != 0)
    pairs = [
        ("Project", F.col("project_name")),
        ("Level", F.coalesce(_given("level"), F.lit("error"))),
        ("Where", _given("culprit")),
        ("Environment", _given("environment")),
        ("Occurrences", F.when(again, F.col("count").cast("string"))),
    ]
    return F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs]), lambda p: p.value.isNotNull())


def subject(app: str = APP_NAME) -> Column:
    return F.concat(F.lit(f"[{app}] "), _by_kind(HEADINGS), F.lit(" in "), "project_name", F.lit(": "), "title")


def slack_payload(app: str = APP_NAME, base: str = BASE_URL) -> Column:
    def words(kind: str, value: Column, emoji: bool = False) -> Column:
        fields = [F.lit(kind).alias("type"), value.alias("text")]
        return F.struct(*fields, *([F.lit(True).alias("emoji")] if emoji else []))

    url = issue_url(base)
    section = F.concat(F.lit("*<"), url, F.lit("|"), text.escape_chat(F.col("title")), F.lit(">*\n"), _by_kind(INTROS))
    fields = F.transform(facts(), lambda p: words("mrkdwn", F.concat(F.lit("*"), p["name"], F.lit("*\n"), text.escape_chat(p["value"]))))
    blocks = [
        F.to_json(F.struct(F.lit("header").alias("type"), words("plain_text", F.concat(_by_kind(EMOJI), F.lit(" "), _by_kind(HEADINGS)), True).alias("text"))),
        F.to_json(F.struct(F.lit("section").alias("type"), words("mrkdwn", section).alias("text"))),
        F.to_json(F.struct(F.lit("section").alias("type"), fields.alias("fields"))),
        F.to_json(F.struct(F.lit("actions").alias("type"), F.array(F.struct(
            F.lit("button").alias("type"), words("plain_text", F.lit(f"Open in {app}"), True).alias("text"),
            url.alias("url"), F.lit("danger").alias("style"))).alias("elements"))),
    ]
    # blocks differ in shape, so the array is assembled from their texts
    head = F.to_json(F.struct(subject(app).alias("text")))
    return F.concat(F.left(head, F.length(head) - 1), F.lit(',"blocks":['), F.concat_ws(",", *blocks), F.lit("]}"))


def discord_payload(app: str = APP_NAME, base: str = BASE_URL) -> Column:
    fields = F.transform(facts(), lambda p: F.struct(
        p["name"].alias("name"), F.coalesce(F.nullif(text.varchar(p["value"], 1000), F.lit("")), F.lit("—")).alias("value"),
        (p["name"] != "Where").alias("inline")))
    embed = F.struct(
        text.varchar(F.col("title"), 240).alias("title"), issue_url(base).alias("url"), _by_kind(INTROS).alias("description"),
        _by_kind(COLORS).alias("color"), fields.alias("fields"), F.struct(F.lit(app).alias("text")).alias("footer"))
    return F.to_json(F.struct(F.array(embed).alias("embeds")))


def email_text(base: str = BASE_URL) -> Column:
    lines = F.array_join(F.transform(facts(), lambda p: F.concat(p["name"], F.lit(": "), p["value"])), "\n")
    return F.concat_ws("\n", _by_kind(INTROS), F.lit(""), F.col("title"), lines, F.lit(""), F.concat(F.lit("View it: "), issue_url(base)))


def email_rows() -> Column:
    """Fact rows of the HTML body, escaped."""
    return F.array_join(F.transform(facts(), lambda p: F.concat(
        F.lit("<tr><td>"), text.escape_html(p["name"]), F.lit("</td><td>"), text.escape_html(p["value"]), F.lit("</td></tr>"))), "")


def render(issues: DataFrame, app: str = APP_NAME, base: str = BASE_URL) -> DataFrame:
    """All renderings of an issue: project_name, issue_id, title, culprit, level, environment, count, kind."""
    return issues.select(
        "project_id", "issue_id", "kind", facts().alias("facts"), subject(app).alias("subject"),
        slack_payload(app, base).alias("slack"), discord_payload(app, base).alias("discord"),
        email_text(base).alias("text"), email_rows().alias("html_rows"))


def drop_suppressed(recipients: DataFrame, suppressions: DataFrame, types: list[str]) -> DataFrame:
    """Recipients whose address is not on the list for one of ``types``."""
    blocked = suppressions.where(F.col("type").isin(*types)).select(F.lower("email").alias("_address")).distinct()
    return recipients.withColumn("_address", F.lower("email")).join(blocked, "_address", "left_anti").drop("_address")


def destinations(projects: DataFrame, users: DataFrame, channels: DataFrame, suppressions: DataFrame | None = None) -> DataFrame:
    """(project_id, project_name, via, target): the owner's address and every valid enabled channel."""
    mail = owner_contacts(projects, users).where(F.coalesce("email", F.lit("")) != "")
    if suppressions is not None:
        mail = drop_suppressed(mail, suppressions, ["bounce", "complaint"])
    mail = mail.select("project_id", "project_name", F.lit("email").alias("via"), F.col("email").alias("target"))
    hooks = enabled_channels(channels, projects).where(text.webhook_error(F.col("type"), F.col("webhook_url")).isNull())
    return mail.unionByName(hooks.select("project_id", "project_name", F.col("type").alias("via"), F.col("webhook_url").alias("target")))


def outbox(issues: DataFrame, places: DataFrame) -> DataFrame:
    """One row per issue and destination; a project with most of the issues is spread out."""
    return salted_join(issues, places, ["project_id"], "inner", row_key=F.xxhash64("issue_id"))
