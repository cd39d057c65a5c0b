"""Stored JSON as people read it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import ship_by_value

_INDEX = re.compile(r"0|[1-9]\d{0,9}")


def _number(value: float) -> str:
    """Shortest digits of a double; plain from 1e-6 to under 1e21."""
    size = abs(value)
    if size == 0:
        return "0"
    if size == float("inf"):
        return "null"
    if 1e-6 <= size < 1e21:
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return re.sub(r"e([+-])0+", r"e\1", repr(value))


def _written(value, indent: str) -> str:
    inner = indent + "  "
    if isinstance(value, dict):
        # keys that are array indexes come first, by number; the others as they stand
        index = sorted((k for k in value if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
        keys = index + [k for k in value if k not in set(index)] if index else list(value)
        parts = [f"{json.dumps(k, ensure_ascii=False)}: {_written(value[k], inner)}" for k in keys]
        brackets = "{}"
    elif isinstance(value, list):
        parts, brackets = [_written(v, inner) for v in value], "[]"
    elif isinstance(value, float):
        return _number(value)
    else:
        return json.dumps(value, ensure_ascii=False)
    if not parts:
        return brackets
    return brackets[0] + "\n" + ",\n".join(inner + p for p in parts) + "\n" + indent + brackets[1]


def _refuse(name: str):
    raise ValueError(name)


def indented(text: str | None) -> str:
    """JSON text with two blanks a level, keys in their order and numbers as doubles; empty for nothing, unchanged if it is no JSON or nested too deeply to read."""
    if not text:
        return ""
    try:
        return _written(json.loads(text, parse_int=float, parse_constant=_refuse), "")
    except (ValueError, RecursionError):
        return text


def pretty_json(column: Column) -> Column:
    """``indented`` for a column."""

    def show(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([indented(x) for x in batch.to_pylist()], pa.string())

    show.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(show, "string")(column)


ship_by_value(__name__)
