"""Analytics over a query log: id, query, duration (ms), connection, error, executed_at, transaction_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds.
SLOW_MS = 100
RETENTION_DAYS = 7

# Quoted strings, and numbers that are not part of a name.
_LITERAL = r"'[^']*+(?:''[^']*+)*+'|[0-9](?<![0-9A-Za-z_][0-9])[0-9]*+(?:\.[0-9]+)?(?![0-9A-Za-z_])"


def normalize_query(query: Column) -> Column:
    """Literals, numbers and lists of them become placeholders; whitespace collapses."""
    text = F.regexp_replace(query, _LITERAL, "?")
    text = F.regexp_replace(text, r"\(\s*+\?(?:\s*+,\s*+\?)+\s*+\)", "(?)")
    return F.trim(F.regexp_replace(text, r"\s{2,}+|[\t-\r]", " "))


def query_type(query: Column) -> Column:
    return F.upper(F.regexp_extract(query, r"^\s*([A-Za-z]+)", 1))


def status(duration: Column, error: Column, slow_ms: int = SLOW_MS) -> Column:
    return F.when(error.isNotNull(), "failed").when(duration > slow_ms, "slow").otherwise("completed")


def enrich(logs: DataFrame, slow_ms: int = SLOW_MS) -> DataFrame:
    return (
        logs.withColumn("normalized_query", normalize_query(F.col("query")))
        .withColumn("type", query_type(F.col("query")))
        .withColumn("status", status(F.col("duration"), F.col("error"), slow_ms)))


def stats(enriched: DataFrame, *keys: str) -> DataFrame:
    """Totals by status and duration figures per key."""
    s, d = F.col("status"), F.col("duration")
    return enriched.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(s == "slow").alias("slow"), F.count_if(s == "failed").alias("failed"),
        F.avg(d).alias("avg_ms"), F.max(d).alias("max_ms"))


def duration_quantiles(enriched: DataFrame, quantiles: list[float], *keys: str) -> DataFrame:
    """Quantiles as an array per key; the sketch merges map-side."""
    return enriched.groupBy(*keys).agg(F.percentile_approx("duration", quantiles, 10000).alias("quantiles_ms"))


def recent(enriched: DataFrame, limit: int, since: str | None = None, until: str | None = None, connection: str | None = None,
           wanted_status: str | None = None, kind: str | None = None, search: str | None = None, slowest: bool = False) -> DataFrame:
    """Filtered list, newest or slowest first."""
    out = enriched
    for value, test in ((since, F.col("executed_at") >= since), (until, F.col("executed_at") < until),
                        (connection, F.col("connection") == connection), (wanted_status, F.col("status") == wanted_status),
                        (kind, F.col("type") == kind), (search, F.col("query").ilike(f"%{search}%"))):
        if value is not None:
            out = out.where(test)
    first = [F.desc("duration")] if slowest else []
    return out.orderBy(*first, F.desc("executed_at"), F.desc("id")).limit(limit)


def timeline(enriched: DataFrame, unit: str = "month") -> DataFrame:
    chars = {"year": 4, "month": 7, "day": 10, "hour": 13}[unit]
    return stats(enriched.withColumn("bucket", F.substring("executed_at", 1, chars)), "bucket")


def frequent(enriched: DataFrame, k: int = 10) -> DataFrame:
    counts = enriched.groupBy("normalized_query").agg(F.count("*").alias("times"), F.avg("duration").alias("avg_ms"))
    return counts.orderBy(F.desc("times"), "normalized_query").limit(k)


def prune(logs: DataFrame, as_of: str, days: int = RETENTION_DAYS, excluded: list[str] | None = None) -> DataFrame:
    """Rows inside the retention span whose query matches no excluded pattern."""
    cutoff = F.date_format(F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"), "yyyy-MM-dd HH:mm:ss")
    out = logs.where(F.col("executed_at") >= cutoff)
    for pattern in excluded or []:
        out = out.where(~F.col("query").rlike(pattern))
    return out


def repeated_queries(enriched: DataFrame, over: int) -> DataFrame:
    """Normalised queries run more than ``over`` times in one transaction (N+1 suspects)."""
    return enriched.groupBy("transaction_id", "normalized_query").agg(F.count("*").alias("times")).where(F.col("times") > over)
