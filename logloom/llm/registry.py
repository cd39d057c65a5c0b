"""Queries of this subpackage: name → query, name → SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, directory) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


# Python workers get rows in batches of at most this size, as texts may be long.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound the batches that Python workers get in this session."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A whole given table."""
    bound_batches(spark)
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
