"""Sending functions to executors that do not have this package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module: str) -> None:
    """Pickle the functions and classes of a module whole instead of by import path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
