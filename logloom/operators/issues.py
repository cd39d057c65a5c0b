"""Error shapes as issues: rollups, first release, regressions, spikes, retention.

The product pages promise these without defining them; the definitions here are ours
and stand in each docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from .fixwork import with_fingerprint
from .lineage import cut
from .skew import HOT_ROWS, key_filter, salted_join

_ISSUE = ["project_id", "fingerprint"]


def _numbers(entries: DataFrame) -> DataFrame:
    """Per issue the events, those whose time is not what its order key says, and the order keys of the first and last time: numbers only, so the fold is
    a hash aggregate and no text is sorted or shuffled."""
    key = times.order_key(F.col("timestamp"))
    odd = ~F.col("timestamp").eqNullSafe(times.key_text(F.col("key")))
    keyed = with_fingerprint(entries).select(*_ISSUE, "timestamp", key.alias("key"))
    return cut(keyed.groupBy(*_ISSUE).agg(F.count("*").alias("events"), F.count_if(odd).alias("odd"), F.min("key").alias("first_key"), F.max("key").alias("last_key")))


def _at_key(entries: DataFrame, numbers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Events of every issue whose order key is that in ``key``.

    The scan first drops rows whose project and key no issue asks for, by a filter of fixed size; shapes are made only of the rows left.
    """
    asked = numbers.select("project_id", F.col(key).alias("key"))
    rows = entries.select("project_id", "level", "channel", "message", *[c for c in columns if c not in ("level", "channel", "message")], times.order_key(F.col("timestamp")).alias("key"))
    held = F.col("project_id").isNull() | key_filter(asked, ["project_id", "key"])(F.col("project_id"), F.col("key"))
    near = with_fingerprint(rows.where(held)).alias("e")
    n = numbers.select(*_ISSUE, F.col(key).alias("key")).alias("n")
    same = F.col("e.project_id").eqNullSafe(F.col("n.project_id")) & (F.col("e.fingerprint") == F.col("n.fingerprint")) & (F.col("e.key") == F.col("n.key"))
    return near.join(n, same, "left_semi").select(*_ISSUE, *columns)


def first_events(entries: DataFrame, numbers: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the earliest event of every issue, by time text and id. Among events of one order key a rank filter decides, which prunes in the map task."""
    rank = F.row_number().over(Window.partitionBy(*_ISSUE).orderBy("timestamp", "id"))
    near = _at_key(entries, numbers, "first_key", list(dict.fromkeys(["timestamp", "id", *columns])))
    return near.withColumn("_rn", rank).where("_rn = 1").select(*_ISSUE, *columns)


def _join_issue(numbers: DataFrame, side: DataFrame, how: str) -> DataFrame:
    side = side.withColumnsRenamed({c: f"_{c}" for c in _ISSUE})
    same = F.col("project_id").eqNullSafe(F.col("_project_id")) & (F.col("fingerprint") == F.col("_fingerprint"))
    return numbers.join(side, same, how).drop(*[f"_{c}" for c in _ISSUE])


def issue_rollup(entries: DataFrame) -> DataFrame:
    """One row per (project, shape): events, first and last time, title, release, level, channel and environment of the first event; an event without a time comes first.

    The first scan folds numbers, the second fetches the texts of first events only. A last time is written from its number;
    a third scan reads it where an issue has times of another shape.
    """
    numbers = _numbers(entries)
    texts = ["timestamp", "message", "release", "level", "channel", "environment"]
    first = first_events(entries, numbers, texts).withColumnsRenamed({"timestamp": "first_seen", "message": "title", "release": "first_release"})
    rows, last = _join_issue(numbers, first, "inner"), times.key_text(F.col("last_key"))
    if not numbers.where("odd > 0").isEmpty():
        latest = F.row_number().over(Window.partitionBy(*_ISSUE).orderBy(F.desc("timestamp")))
        read = _at_key(entries, numbers.where("odd > 0"), "last_key", ["timestamp"]).withColumn("_rn", latest).where("_rn = 1")
        rows, last = _join_issue(rows, read.select(*_ISSUE, F.col("timestamp").alias("_last")), "left"), F.when(F.col("odd") > 0, F.col("_last")).otherwise(last)
    return rows.select(*_ISSUE, "events", "first_seen", last.alias("last_seen"), "title", "first_release", "level", "channel", "environment")


def affected_users(entries: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct ``id`` values of ``user_context`` per (project, shape), in an aggregate of its own so that texts don't travel per user.

    The exact count shuffles distinct (issue, user) pairs, the approximate one sketches.
    """
    user = F.get_json_object("user_context", "$.id")
    return with_fingerprint(entries).select(*_ISSUE, user.alias("user")).groupBy(*_ISSUE).agg(
        (F.count_distinct("user") if exact else F.approx_count_distinct("user")).alias("users"))


def top_issues(issues: DataFrame, k: int = 10) -> DataFrame:
    """The k issues with most events; ties by project and shape."""
    return issues.orderBy(F.desc("events"), *_ISSUE).limit(k)


def first_releases(entries: DataFrame) -> DataFrame:
    """Release of the earliest event of every issue."""
    return first_events(entries, _numbers(entries), ["release"]).withColumnRenamed("release", "first_release")


def issue_moments(entries: DataFrame, gap_days: int = 3) -> DataFrame:
    """``new`` at an issue's first event, ``regression`` at an event after a quiet gap.

    A gap of whole days always crosses a day border, so comparing each day's first event
    with the last event of the previous active day finds every gap; a hot issue is
    ranked by days, not by events. Unparseable times are left out.
    """
    if gap_days < 1:
        raise ValueError("gap_days must be at least 1")
    at = with_fingerprint(entries).withColumn("ts", times.event_ts(F.col("timestamp"))).where("ts is not null")
    days = at.groupBy(*_ISSUE, F.to_date("ts").alias("day")).agg(
        F.min(F.struct("ts", "id")).alias("opening"), F.max("ts").alias("closing"))
    order = Window.partitionBy(*_ISSUE).orderBy("day")
    quiet = F.unix_millis("opening.ts") - F.unix_millis(F.lag("closing").over(order))
    return (
        days.withColumn("quiet_ms", quiet)
        .withColumn("moment", F.when(F.col("quiet_ms").isNull(), "new").when(F.col("quiet_ms") >= gap_days * 86_400_000, "regression"))
        .where("moment is not null")
        .select(*_ISSUE, "moment", F.col("opening.id").alias("log_entry_id"), times.iso_millis(F.col("opening.ts")).alias("at"), "quiet_ms"))


def regressions_after(entries: DataFrame, resolved: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """First event after the resolved mark of an issue: ``resolved(project_id, fingerprint, resolved_at)``."""
    shaped = with_fingerprint(entries).select(*_ISSUE, "id", "timestamp")
    after = salted_join(shaped, resolved, _ISSUE, "inner", row_key=F.xxhash64("id"), min_rows=min_rows).where(
        F.col("timestamp") > F.col("resolved_at"))
    return after.groupBy(*_ISSUE).agg(
        F.min_by("id", F.struct("timestamp", "id")).alias("log_entry_id"), F.count("*").alias("events_since"))


def spikes(entries: DataFrame, floor: int = 10, back: int = 24) -> DataFrame:
    """Hours whose count exceeds mean + 3 deviations of the ``back`` hours before, and ``floor``.

    Silent hours count as zero. Sums stay integers until the last step.
    """
    hour = F.floor(F.unix_seconds(times.event_ts(F.col("timestamp"))) / 3600).cast("bigint")
    counts = entries.withColumn("hour", hour).where("hour is not null").groupBy("project_id", "hour").agg(F.count("*").alias("events"))
    # A range of hours before the row; hours without events add nothing to either sum.
    hours = Window.partitionBy("project_id").orderBy("hour")
    before, start = hours.rangeBetween(-back, -1), hours.rangeBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("bigint"))
    stats = counts.select("project_id", "hour", "events", F.min("hour").over(start).alias("first"), total(F.col("events")).alias("s"),
                          total(F.col("events") * F.col("events")).alias("q"), F.lit(back).cast("bigint").alias("n")).where(F.col("hour") - F.col("first") >= back)
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n")))
    return (
        stats.withColumn("mean", mean).withColumn("deviation", deviation)
        .where((F.col("events") > F.col("mean") + 3 * F.col("deviation")) & (F.col("events") >= floor))
        .select("project_id", F.date_format(F.timestamp_seconds(F.col("hour") * 3600), "yyyy-MM-dd HH:mm:ss").alias("hour"),
                "events", "mean", "deviation"))


def environment_split(entries: DataFrame, environments: list[str]) -> DataFrame:
    """Events per issue and environment, one column each; fixed names need no extra pass."""
    return with_fingerprint(entries).groupBy(*_ISSUE).agg(
        *[F.count_if(F.col("environment") == e).alias(e) for e in environments])


def retain(entries: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Entries not older than ``days``; unparseable times are kept."""
    ts = times.event_ts(F.col("timestamp"))
    cutoff = times.as_instant(as_of) - F.expr(f"interval {days} days")
    return times.prune_days(entries, cutoff).where(ts.isNull() | (ts >= cutoff))


def severity_cube(entries: DataFrame) -> DataFrame:
    """Counts by project, environment and level with all subtotals; ``grouping`` tells them apart."""
    return entries.cube("project_id", "environment", "level").agg(
        F.count("*").alias("events"), F.grouping_id().cast("bigint").alias("grouping"))


def severity_rollup(entries: DataFrame) -> DataFrame:
    return entries.rollup("project_id", "environment", "level").agg(
        F.count("*").alias("events"), F.grouping_id().cast("bigint").alias("grouping"))
