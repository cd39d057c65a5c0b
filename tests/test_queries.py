"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest

from logloom.plans import catalog
from tools.check import compare

from .conftest import DATA


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    status, _, note = compare(spark, name, catalog.QUERIES[name], catalog.SQL.get(name), DATA)
    assert status in ("ok", "rows-only", "rows-only EMPTY"), note


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
