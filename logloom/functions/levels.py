"""The eight ordered severities and the labels shown for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in ascending order (RFC 5424 / PSR-3).
LEVELS = ["debug", "info", "notice", "warning", "error", "critical", "alert", "emergency"]
DEFAULT_LEVEL = "info"

# Short labels that differ from the upper-cased level.
CHIP_LABELS = {"emergency": "EMERG", "critical": "CRIT", "warning": "WARN", "notice": "NOTE"}

ERROR_LEVELS = LEVELS[LEVELS.index("error"):]
FIXABLE_LEVELS = LEVELS[LEVELS.index("warning"):]


def normalize_level(level: Column) -> Column:
    """Exact, case-sensitive membership; anything else becomes ``info``."""
    return F.when(level.isin(*LEVELS), level).otherwise(F.lit(DEFAULT_LEVEL))


def severity(level: Column) -> Column:
    """Ordinal 0..7, NULL for an unknown level."""
    return F.nullif(F.array_position(F.lit(LEVELS), level), F.lit(0)).cast("int") - 1


def at_or_above(floor: str | None) -> list[str] | None:
    """Levels passing a minimum-severity floor; ``None`` means no filter."""
    if floor not in ("info", "warning", "error"):
        return None
    return LEVELS[LEVELS.index(floor):]


def fixable(level: Column) -> Column:
    return F.lower(F.coalesce(level, F.lit(""))).isin(*FIXABLE_LEVELS)


def _or_default(level: Column, default: str) -> Column:
    return F.when(F.coalesce(level, F.lit("")) == "", F.lit(default)).otherwise(level)


def chip_label(level: Column) -> Column:
    short = F.create_map(*[F.lit(x) for pair in CHIP_LABELS.items() for x in pair])
    return F.coalesce(short[level], F.upper(_or_default(level, "info")))


def level_label(level: Column) -> Column:
    return F.upper(_or_default(level, "info"))


def level_key(level: Column) -> Column:
    """Style key. A missing level is ``debug`` here, unlike the labels."""
    return _or_default(level, "debug")
