"""Loads every query module; ``QUERIES`` and ``SQL`` are complete afterwards."""

from __future__ import annotations

from . import access, fixwork, ingest, issues, quota, relational, search, statistics, stream, streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
