"""Name → query and name → SQL for the driver contract."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables
from .sql_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _with_views(sql: str) -> str:
    """Prefix the derived views a statement mentions, dependencies first."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} as ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    recursive = ""
    if body.lower().startswith("with recursive"):
        recursive, body = " recursive", body[len("with recursive"):]
        return f"with{recursive} {ctes},\n{body}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, directory: fn(Tables(spark, directory))
        if sql is not None:
            SQL[name] = _with_views(sql)
        return fn

    return wrap
