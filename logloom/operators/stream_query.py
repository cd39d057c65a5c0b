"""Filtering, paging and counting of the flat log stream."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels, text, times
from ..schema import STREAM_COLUMNS

PAGE_SIZE = 50
# Dashboard time ranges.
RANGES = {"1h": "1 hour", "24h": "24 hours", "7d": "7 days", "30d": "30 days", "all": None}
DEFAULT_RANGE = "24h"


def resolve_limit(limit: int | float | str | None, default: int = 100, top: int = 200) -> int:
    """``min(200, max(1, n or 100))``; zero and non-numbers mean the default."""
    try:
        n = float(limit) if limit is not None else 0.0
    except ValueError:
        n = 0.0
    if math.isnan(n) or n == 0:
        n = default
    return int(min(top, max(1, n)))


def level_set(level: str | None) -> list[str]:
    """Valid names of a comma-separated list; nothing valid means no filter."""
    wanted = [part.strip().lower() for part in (level or "").split(",")]
    return [name for name in wanted if name in levels.LEVELS]


def message_search(term: str | None) -> Column:
    """Case-insensitive contains; the user's ``%`` and ``_`` stay wildcards."""
    return F.col("message").ilike(text.like_pattern((term or "")[:200]))


def stream_filter(df: DataFrame, project: str | None = None, level: str | None = None, channel: str | None = None,
                  environment: str | None = None, trace: str | None = None, request: str | None = None,
                  q: str | None = None, before: str | None = None, normalize_key: bool = False) -> DataFrame:
    """Conjunction of the optional predicates, all of them pushable to the scan but the search.

    Ids longer than 64 characters are stored with an ellipsis, so a plain prefix never
    finds them; ``normalize_key`` shortens the argument the way ingest does.
    """
    limit = text.MAX_CORRELATION

    def key(value: str) -> str:
        if normalize_key and len(value) > limit:
            return value[: limit - 1] + "…"
        return value[:limit]

    out = df
    if project:
        out = out.where(F.col("project_id") == project)
    names = level_set(level)
    if names:
        out = out.where(F.col("level").isin(*names))
    if channel:
        out = out.where(F.col("channel") == channel)
    if environment:
        out = out.where(F.col("environment") == environment)
    if trace:
        out = out.where(F.col("trace_id") == key(trace))
    if request:
        out = out.where(F.col("request_id") == key(request))
    if q:
        out = out.where(message_search(q))
    if before:
        out = out.where(F.col("timestamp") < before)
    return out


def newest_first(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(F.desc("timestamp"), F.desc("id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def stream_query(df: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """One page of the stream, newest first, without the JSON columns."""
    return newest_first(stream_filter(df, **filters).select(*STREAM_COLUMNS), resolve_limit(limit))


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """The oldest timestamp of a full page, NULL when the page is not full."""
    return page.agg(F.count("*").alias("rows"), F.min("timestamp").alias("oldest")).select(
        "rows", F.when(F.col("rows") == limit, F.col("oldest")).alias("next_cursor"))


def page_after(df: DataFrame, timestamp: str, entry_id: str, limit: int) -> DataFrame:
    """Keyset page that keeps rows tied with the cursor.

    The plain ``timestamp <=`` bound is implied by the tie-aware test and reaches the scan.
    """
    at, eid = F.col("timestamp"), F.col("id")
    tied = (at < timestamp) | ((at == timestamp) & (eid < entry_id))
    return newest_first(df.where((at <= timestamp) & tied), limit)


def in_range(df: DataFrame, range_key: str | None, as_of: str) -> DataFrame:
    """Entries whose parsed time lies within a named range before ``as_of``; unknown means 24 h."""
    span = RANGES.get(range_key or "", RANGES[DEFAULT_RANGE])
    if span is None:
        return df
    since = times.as_instant(as_of) - F.expr(f"interval {span}")
    return times.prune_days(df, since).where(times.event_ts(F.col("timestamp")) >= since)


def dashboard_filter(df: DataFrame, as_of: str, project: str | None = None, floor: str | None = None,
                     range_key: str | None = None, q: str | None = None) -> DataFrame:
    """Minimum severity, time range and search; ``all`` and ``debug`` keep rows without a level."""
    out = df.where(F.col("project_id") == project) if project else df
    names = levels.at_or_above(floor)
    if names:
        out = out.where(F.col("level").isin(*names))
    out = in_range(out, range_key, as_of)
    return out.where(message_search(q)) if q else out


def dashboard_page(df: DataFrame, page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """Offset page, newest first. Deep pages cost their offset; prefer ``page_after``."""
    return newest_first(df, page_size, max(0, page - 1) * page_size)


def pager(df: DataFrame, requested: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """Total and page bounds of a filtered stream, the requested page clamped to the last."""
    total, page, pages = F.col("total"), F.col("page"), F.col("pages")
    size = F.lit(page_size).cast("bigint")
    return (
        df.agg(F.count("*").alias("total"))
        .withColumn("pages", F.greatest(F.lit(1).cast("bigint"), F.ceil(total / size)))
        .withColumn("page", F.least(F.lit(max(1, requested)).cast("bigint"), pages))
        .select(
            "total", "pages", "page",
            F.when(total == 0, F.lit(0).cast("bigint")).otherwise((page - 1) * size + 1).alias("from_row"),
            F.least(page * size, total).alias("to_row"),
            (page > 1).alias("has_prev"), (page < pages).alias("has_next"))
    )


def severity_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Total, warnings, and errors (error and worse), one partial aggregate per task."""
    level = F.col("level")
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(level == "warning").alias("warnings"),
        F.count_if(level.isin(*levels.ERROR_LEVELS)).alias("errors"))
