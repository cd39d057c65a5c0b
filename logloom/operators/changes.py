"""Applying change events to tables.

Folds use ``min_by``/``max_by``, which combine map-side: a hot key ships one partial
row per task. Only keyed, already reduced rows are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_email
from .skew import salted_join


def upsert(target: DataFrame, changes: DataFrame, key: str, version: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Newest change per key replaces the row; ``keep`` columns survive from the first write."""
    columns = [c for c in target.columns if c != key]
    order = F.struct(*version)
    newest = changes.groupBy(key).agg(
        F.max_by(F.struct(*columns), order).alias("new"),
        *[F.min_by(F.col(c), order).alias(f"first_{c}") for c in keep])
    old = target.select(key, F.struct(*columns).alias("old"))
    merged = old.join(newest, key, "full_outer")

    def pick(c: str) -> Column:
        if c in keep:
            return F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"first_{c}"))
        return F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    return merged.select(key, *[pick(c).alias(c) for c in columns])


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Append rows whose key is new; among equal new keys the first one wins."""
    columns = [c for c in target.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*key, "r.*")
    return target.unionByName(first.join(target.select(*key), key, "left_anti").select(*target.columns))


def delete_for(table: DataFrame, deleted: DataFrame, on: str = "project_id") -> DataFrame:
    """Rows whose parent is not among the deleted ids."""
    return table.join(deleted.select(F.col("id").alias(on)), on, "left_anti")


def update_by_key(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Replace ``columns`` where the key is in the change set; one change per key."""
    new = changes.select(key, F.struct(*columns).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.select(*[
        (F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c)
        for c in table.columns])


def sync_subscriptions(events: DataFrame, users: DataFrame) -> DataFrame:
    """Fold lifecycle events into one row per subscription.

    The first event of a known customer inserts; later ones change status, price and
    unit price only; a delete cancels a row that exists. Events are reduced per
    (subscription, customer) before the customer lookup, so its cost does not depend
    on how many events there are.
    """
    order = F.struct("at", "event_id")
    is_delete = F.col("kind") == "deleted"
    write = F.when(~is_delete, order)
    reduced = events.groupBy("provider_id", "customer").agg(
        F.min(write).alias("first_write"), F.min_by("quantity", write).alias("quantity"),
        F.max(write).alias("last_write"),
        F.max_by(F.struct("status", "price_id", "unit_price"), write).alias("last"),
        F.max(F.when(is_delete, order)).alias("last_delete"))
    known = users.select(F.col("id").alias("user_id"), F.col("stripe_id").alias("customer"))
    mine = reduced.join(known, "customer", "left")
    has_user = F.col("user_id").isNotNull()
    first, last = F.when(has_user, F.col("first_write")), F.when(has_user, F.col("last_write"))
    folded = mine.groupBy("provider_id").agg(
        F.min(first).alias("first_write"),
        F.min_by(F.struct("user_id", "quantity"), first).alias("created"),
        F.max(last).alias("last_write"), F.max_by("last", last).alias("last"),
        F.max("last_delete").alias("last_delete"),
    ).where(F.col("first_write").isNotNull())
    canceled = F.coalesce(F.col("last_delete") > F.col("last_write"), F.lit(False))
    return folded.select(
        "provider_id", F.col("created.user_id").alias("user_id"),
        F.lit("default").alias("type"), F.lit("pro").alias("plan"),
        F.when(canceled, F.lit("canceled")).otherwise(F.col("last.status")).alias("provider_status"),
        F.lit("stripe").alias("provider_type"),
        F.coalesce("last.price_id", F.lit("")).alias("provider_price_id"),
        F.coalesce("last.unit_price", F.lit(0).cast("bigint")).alias("unit_price"),
        F.coalesce("created.quantity", F.lit(1)).alias("quantity"))


def plans(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``pro`` for users with a live default subscription, else ``free``."""
    live = subscriptions.where((F.col("type") == "default") & F.col("provider_status").isin("active", "trialing"))
    paying = live.select(F.col("user_id").alias("id")).distinct().withColumn("live", F.lit(True))
    return users.join(paying, "id", "left").select(
        F.col("id").alias("user_id"), F.when(F.col("live"), "pro").otherwise("free").alias("plan"))


def merge_social(users: DataFrame, logins: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fold social logins by canonical address into (accounts, rejected).

    ``logins``: provider, social_id, name, email, avatar, verified. An unverified login
    may open an account but is never linked to an existing one.
    """
    seq = F.struct(*order)
    logins = logins.withColumn("address", canonical_email(F.col("email"))).withColumn("seq", seq)
    valid = logins.where(F.col("address") != "")
    row = F.struct("provider", "social_id", "name", "avatar")
    ok = F.coalesce(F.col("verified"), F.lit(True))
    trusted = F.when(ok, F.col("seq"))
    folded = valid.groupBy("address").agg(
        F.min("seq").alias("first_seq"), F.min_by(row, "seq").alias("first"),
        F.max_by(row, trusted).alias("last"),
        F.max_by("avatar", F.when(F.col("avatar").isNotNull(), trusted)).alias("new_avatar"))
    known = users.select(canonical_email(F.col("email")).alias("address"), F.col("id").alias("user_id"),
                         F.col("name").alias("user_name"), F.col("avatar").alias("user_avatar"))
    joined = folded.join(known, "address", "left")
    is_new = F.col("user_id").isNull()
    final = F.when(F.col("last").isNotNull(), F.col("last")).when(is_new, F.col("first"))
    name = F.coalesce(F.nullif(F.col("first.name"), F.lit("")), F.substring_index("address", "@", 1))
    accounts = joined.where(is_new | F.col("last").isNotNull()).select(
        "address", "user_id", F.when(is_new, "created").otherwise("linked").alias("action"),
        F.when(is_new, name).otherwise(F.col("user_name")).alias("name"),
        final["provider"].alias("provider"), final["social_id"].alias("social_id"),
        F.coalesce("new_avatar", F.when(is_new, F.col("first.avatar")), "user_avatar").alias("avatar"))
    blank = logins.where(F.col("address") == "").select("social_id", F.lit("no email").alias("reason"))
    unverified = (
        salted_join(valid.where(~ok), joined.select("address", "first_seq", "user_id"), ["address"], "inner", row_key=F.xxhash64("seq"))
        .where(F.col("user_id").isNotNull() | (F.col("seq") > F.col("first_seq")))
        .select("social_id", F.lit("unverified email").alias("reason")))
    return accounts, blank.unionByName(unverified)


def accept_invites(invites: DataFrame, members: DataFrame, users: DataFrame, attempts: DataFrame) -> DataFrame:
    """Verdict per (user_id, token) attempt: 200, 400 without token, 403 other address, 404 unknown."""
    who = users.select(F.col("id").alias("user_id"), canonical_email(F.col("email")).alias("address"))
    inv = invites.select(F.col("id").alias("invite_id"), "token", "project_id", F.lower("email").alias("invited"))
    joined = attempts.join(who, "user_id").join(inv, "token", "left")
    status = (F.when(F.coalesce(F.trim("token"), F.lit("")) == "", 400).when(F.col("invite_id").isNull(), 404)
              .when(F.col("invited") != F.col("address"), 403).otherwise(200))
    return joined.select("user_id", "token", "invite_id", "project_id", "address", status.alias("status"))


def after_acceptance(verdicts: DataFrame, members: DataFrame, invites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Member and invite tables once accepted invites have moved over."""
    done = verdicts.where("status = 200")
    current = members.select("project_id", F.lower("email").alias("address"))
    fresh = done.select("project_id", "address").distinct().join(current, ["project_id", "address"], "left_anti")
    joined = fresh.select(
        F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("|", "project_id", "address"), 256), 1, 20)).alias("id"),
        "project_id", F.col("address").alias("email"), F.lit("member").alias("role"))
    remaining = invites.join(done.select(F.col("invite_id").alias("id")), "id", "left_anti")
    return members.select("id", "project_id", "email", "role").unionByName(joined), remaining
