"""Sender-side packing, dead letters, event replay, delivery and hit statistics, array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .commerce import rates
from .running import sums_before

# What one request may carry.
MAX_ENTRIES = 500
MAX_BYTES = 512 * 1024


def pack_batches(entries: DataFrame, sender: str, offset: str, body: Column, max_entries: int = 250, max_bytes: int = 192 * 1024) -> DataFrame:
    """Assign entries to batches that stay well under the request limits.

    An entry weighs its bytes and a comma and is put where its first byte falls in its sender's sequence; with entries of
    at most ``max_bytes`` a batch frames to less than twice that and a wrapper, by default under 400 KiB. Larger entries get
    ``batch`` NULL and go out alone. The packing depends on the entries and the limits alone.
    """
    sized = entries.withColumn("bytes", F.octet_length(body)).withColumn("fits", F.coalesce(F.octet_length(body) <= max_bytes, F.lit(True)))
    weight = (F.coalesce("bytes", F.lit(0)) + 1).cast("bigint")
    placed = sums_before(sized, [sender, "fits"], [offset], {"before": weight}).withColumn("chunk", F.floor(F.col("before") / max_bytes).cast("bigint"))
    # A chunk holds at most ``max_bytes`` entries, as each weighs a byte or more.
    within = Window.partitionBy(sender, "fits", "chunk").orderBy(offset)
    placed = placed.withColumn("slice", F.floor((F.row_number().over(within) - 1) / max_entries).cast("bigint"))
    name = F.concat_ws("-", F.col(sender).cast("string"), F.col("chunk").cast("string"), F.col("slice").cast("string"))
    return placed.withColumn("batch", F.when(F.col("fits"), name)).drop("before", "chunk", "slice", "fits")


def dead_letters(rows: DataFrame, as_of: Column, max_attempts: int = 3, days: int = 7) -> DataFrame:
    """Verdict per failed row: ``expired`` past retention, ``discard`` when out of attempts, else ``retry``."""
    age = F.col("failed_at") < as_of - F.expr(f"interval {days} days")
    verdict = F.when(age, "expired").when(F.col("attempts") >= max_attempts, "discard").otherwise("retry")
    return rows.withColumn("verdict", verdict)


def replay(events: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """State of each key after its last event, with first and last order and the event count."""
    o = F.struct(*order)
    return events.groupBy(key).agg(
        F.max_by(F.struct(*state), o).alias("state"), F.min(o).alias("first"), F.max(o).alias("last"), F.count("*").alias("events"),
    ).select(key, "state.*", F.col(f"first.{order[0]}").alias("first_at"), F.col(f"last.{order[0]}").alias("last_at"), "events")


def delivery_metrics(events: DataFrame, keys: list[str], kind: str) -> DataFrame:
    k = F.col(kind)
    return rates(events, keys, {name: k == name for name in ("delivered", "bounced", "opened")})


def bounced_addresses(events: DataFrame, kind: str, address: str) -> DataFrame:
    """Rows for the suppression list: addresses with at least one bounce."""
    return events.where(F.col(kind) == "bounced").groupBy(F.lower(address).alias("email")).agg(
        F.count("*").alias("bounces")).withColumn("type", F.lit("bounce"))


def hit_rate(accesses: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    return rates(accesses, keys, {"hit": hit})


def chunk_array(items: Column, size: int) -> Column:
    """Array of arrays of at most ``size`` items."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(items, s, F.lit(size)))


def group_array(items: Column, label) -> Column:
    """Map from label to the items carrying it, in order."""
    keys = F.array_distinct(F.transform(items, label))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(items, lambda x: label(x) == k)))
