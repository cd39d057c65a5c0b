from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from logloom.sources.tables import Tables
    return Tables(spark, DATA)


@pytest.fixture
def one(spark):
    """Evaluate an expression over one row of named values."""
    def run(expr, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
        return row.select(expr.alias("x")).first()["x"]
    return run
