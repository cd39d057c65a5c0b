"""Who sees which project, entry, member, invite and channel.

Access is "owner or member". Evaluated for many users at once an OR condition would
become a nested-loop join, so it is written as the union of two equi-joins. No join
is hinted: small control tables are broadcast by measured size, others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_email
from .skew import salted_join


def owner_pairs(users: DataFrame, projects: DataFrame) -> DataFrame:
    """(user_id, project_id) where the user owns the project."""
    u = users.select(F.col("id").alias("user_id"))
    p = projects.select(F.col("id").alias("project_id"), F.col("owner_id").alias("user_id"))
    return p.join(u, "user_id").select("user_id", "project_id")


def member_pairs(users: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, project_id) where the user's address is among the members."""
    u = users.select(F.col("id").alias("user_id"), canonical_email(F.col("email")).alias("address"))
    m = members.select("project_id", F.lower("email").alias("address"))
    return m.join(u, "address").select("user_id", "project_id").distinct()


def access_pairs(users: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, project_id, is_owner), one row per visible project and user."""
    ours = owner_pairs(users, projects).withColumn("is_owner", F.lit(True))
    theirs = member_pairs(users, members).withColumn("is_owner", F.lit(False))
    existing = theirs.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    return ours.unionByName(existing).groupBy("user_id", "project_id").agg(F.max("is_owner").alias("is_owner"))


def accessible(projects: DataFrame, user_id: int, users: DataFrame, members: DataFrame) -> DataFrame:
    """Projects one user may read."""
    one = users.where(F.col("id") == user_id)
    pairs = access_pairs(one, projects, members).select(F.col("project_id").alias("id"))
    return projects.join(pairs, "id", "left_semi")


def owned(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """(user_id, project_id) requests that pass the owner-only rule."""
    p = projects.select(F.col("id").alias("project_id"), F.col("owner_id").alias("user_id"))
    return requests.join(p, ["project_id", "user_id"], "left_semi")


def visible_entries(requests: DataFrame, entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entries for (user_id, id) requests; a missing and a forbidden entry both vanish."""
    found = requests.select("user_id", "id").join(entries, "id")
    return found.join(pairs.select("user_id", "project_id"), ["user_id", "project_id"], "left_semi")


def visible_projects(projects: DataFrame, pairs: DataFrame) -> DataFrame:
    """Project columns with ``is_owner`` for every user who sees the project."""
    p = projects.select(F.col("id").alias("project_id"), "name", "platform", "created_at", "is_active")
    return pairs.join(p, "project_id")


def listed(visible: DataFrame) -> DataFrame:
    """Presentation order of one user's projects."""
    return visible.orderBy(F.col("created_at").desc_nulls_last(), "project_id")


def pending_invites(invites: DataFrame, users: DataFrame, projects: DataFrame) -> DataFrame:
    i = invites.select("token", "project_id", "created_at", F.lower("email").alias("address"))
    u = users.select(F.col("id").alias("user_id"), canonical_email(F.col("email")).alias("address"))
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return i.join(u, "address").join(p, "project_id").select("user_id", "token", "project_name", "created_at")


def people(members: DataFrame, invites: DataFrame, users: DataFrame) -> DataFrame:
    """Members and pending invites of a project in one list."""
    m = members.select("project_id", "id", "email", "role", F.lit("member").alias("kind"))
    known = users.select(F.lower("email").alias("address")).distinct().withColumn("registered", F.lit(True))
    i = (
        invites.withColumn("address", F.lower("email")).join(known, "address", "left")
        .select("project_id", "id", "email", F.lit("invite").alias("kind"),
                F.coalesce("registered", F.lit(False)).alias("registered"))
    )
    return m.unionByName(i, allowMissingColumns=True)


def enabled_channels(channels: DataFrame, projects: DataFrame) -> DataFrame:
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return channels.where("enabled").join(p, "project_id").select("project_id", "id", "type", "webhook_url", "project_name")


def owner_contacts(projects: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("owner_id"), "email")
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "owner_id")
    return p.join(u, "owner_id").select("project_id", "project_name", "email")


def active_project(visible: DataFrame, choices: DataFrame) -> DataFrame:
    """The project shown per user: the requested one, else the remembered one, else the first.

    Only the best row per user is needed, so the rank filter prunes before the shuffle.
    """
    ranked = visible.join(choices, "user_id", "left")
    order = [
        F.coalesce(F.col("project_id") == F.col("requested"), F.lit(False)).desc(),
        F.coalesce(F.col("project_id") == F.col("remembered"), F.lit(False)).desc(),
        F.col("created_at").desc_nulls_last(), F.col("project_id"),
    ]
    best = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return ranked.withColumn("rn", best).where("rn = 1").select("user_id", "project_id", "is_owner")
