"""Analysis runs per error shape: caching, work selection and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels, times
from ..functions.fingerprint import fingerprint_of
from ..schema import ANALYSIS
from .skew import salted_join

# Cache lifetime and active states.
CACHE_HOURS = 168
ACTIVE = ["queued", "running"]

_SHAPE = ["project_id", "fingerprint"]


def with_fingerprint(entries: DataFrame) -> DataFrame:
    return entries.withColumn("fingerprint", fingerprint_of(F.col("level"), F.col("channel"), F.col("message")))


def latest_runs(runs: DataFrame, as_of: str, cache_hours: int = CACHE_HOURS) -> DataFrame:
    """Newest run per (project, shape) that is active or young enough; failed runs count."""
    cutoff = times.utc_hours_ago(as_of, max(1, cache_hours))
    live = runs.where(F.col("status").isin(*ACTIVE) | (F.col("created_at") > cutoff))
    columns = [c for c in runs.columns if c not in _SHAPE]
    return live.groupBy(*_SHAPE).agg(
        F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("run")).select(*_SHAPE, "run.*")


def worklist(entries: DataFrame, runs: DataFrame, as_of: str, cache_hours: int = CACHE_HOURS) -> DataFrame:
    """One entry per unanswered error shape: its first occurrence and the number of repeats."""
    shapes = (
        with_fingerprint(entries.where(levels.fixable(F.col("level"))))
        .groupBy(*_SHAPE).agg(F.min_by("id", F.struct("timestamp", "id")).alias("log_entry_id"),
                              F.min("timestamp").alias("first_seen"), F.count("*").alias("repeats")))
    return shapes.join(latest_runs(runs, as_of, cache_hours).select(*_SHAPE), _SHAPE, "left_anti")


def reuse(entries: DataFrame, latest: DataFrame) -> DataFrame:
    """Fixable entries with the run that answers them; ``reused`` when another entry caused it."""
    shaped = with_fingerprint(entries.where(levels.fixable(F.col("level")))).select("id", *_SHAPE)
    run = latest.select(*_SHAPE, F.col("id").alias("run_id"), "log_entry_id", "status")
    joined = salted_join(shaped, run, _SHAPE, "inner", row_key=F.xxhash64("id"))
    return joined.select("id", "run_id", "status", (F.col("log_entry_id") != F.col("id")).alias("reused"))


def recent_occurrences(targets: DataFrame, entries: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """How often each target's exact message occurred in its project lately (text time compare)."""
    cutoff = times.as_instant(as_of) - F.expr(f"interval {days} days")
    since = times.iso_millis(cutoff)
    # a time text with an offset may stand a day off its instant
    counts = times.prune_days(entries, cutoff, slack_days=1).where(F.col("timestamp") > since).groupBy("project_id", "message").agg(F.count("*").alias("occurrences"))
    keyed = targets.select("id", "project_id", F.coalesce("message", F.lit("")).alias("message"))
    joined = salted_join(keyed, counts, ["project_id", "message"], "left", row_key=F.xxhash64("id"))
    return joined.select("id", F.coalesce("occurrences", F.lit(0).cast("bigint")).alias("occurrences"))


def parse_analysis(column: Column) -> Column:
    """Struct of an analysis document, NULL when it is not a JSON object."""
    tree = F.schema_of_variant(F.try_parse_json(column))
    return F.when(tree.startswith("OBJECT<"), F.from_json(column, ANALYSIS))


def run_states(events: DataFrame) -> DataFrame:
    """Fold run events: queued, then running, then the first terminal event after the start.

    Terminal events before the start and anything after the end are ignored.
    """
    order = F.struct("at", "event_id")
    starts = events.groupBy("run_id").agg(
        F.min("at").alias("created_at"), F.min(F.when(F.col("kind") == "running", order)).alias("start"))
    terminal = events.where(F.col("kind").isin("completed", "failed"))
    late = salted_join(terminal, starts.where("start is not null").select("run_id", "start"), ["run_id"], "inner",
                       row_key=F.xxhash64("event_id"))
    ends = late.where(order > F.col("start")).groupBy("run_id").agg(
        F.min_by(F.struct("kind", "at"), order).alias("end"))
    return starts.join(ends, "run_id", "left").select(
        "run_id", "created_at", F.col("start.at").alias("started_at"),
        F.coalesce("end.kind", F.when(F.col("start").isNotNull(), "running").otherwise("queued")).alias("status"),
        F.col("end.at").alias("completed_at"))
