"""Validation rules as columns: per-row errors, valid/quarantine split, rule counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


# Strings

def min_length(c: Column, n: int) -> Column:
    return F.length(c) >= n


def max_length(c: Column, n: int) -> Column:
    return F.length(c) <= n


def exact_length(c: Column, n: int) -> Column:
    return F.length(c) == n


def email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def alphanumeric(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9]+\z")


# Numbers

def integer(c: Column) -> Column:
    return c == F.floor(c)


def positive(c: Column) -> Column:
    return c > 0


def decimal_digits(c: Column, low: int, high: int) -> Column:
    """Digits after the point of the shortest decimal text."""
    digits = F.length(F.regexp_extract(F.regexp_replace(c.cast("string"), r"\.0$", ""), r"\.(\d+)$", 1))
    return digits.between(low, high)


def divisible_by(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n)) == 0


# Arrays

def each(c: Column, test) -> Column:
    return F.forall(c, test)


def unique_items(c: Column) -> Column:
    return F.size(F.array_distinct(c)) == F.size(c)


# Dates

def weekend(c: Column) -> Column:
    return F.dayofweek(c).isin(1, 7)


def weekday(c: Column) -> Column:
    return ~weekend(c)


def unix_range(c: Column, milliseconds: bool = False) -> Column:
    """Seconds (or milliseconds) between 1970 and the year 2038 bound."""
    top = 2147483647 * (1000 if milliseconds else 1)
    return c.between(0, top)


def today(c: Column, as_of: Column) -> Column:
    return F.to_date(c) == F.to_date(as_of)


def datetime_range(c: Column) -> Column:
    """Within the years 1000 to 9999."""
    return F.year(c).between(1000, 9999)


def unix_digits(c: Column) -> Column:
    """A positive number, or its text, of 10 to 13 digits."""
    return c.cast("string").rlike("^[0-9]{10,13}$") & (c.cast("bigint") > 0)


# Results

def model_rules(required: list[str], most: dict[str, int]) -> list[Rule]:
    """Required columns, and largest lengths of optional texts."""
    return [(f"{c} required", F.coalesce(F.col(c), F.lit("")) != "") for c in required] + [
        (f"{c} max", optional(F.col(c), F.length(c) <= n)) for c, n in most.items()]


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``errors`` (names of failed rules, in rule order) and ``valid``. NULL fails a rule."""
    failed = F.array_compact(F.array(*[F.when(~_holds(test), F.lit(name)) for name, test in rules]))
    return df.withColumn("errors", failed).withColumn("valid", F.size("errors") == 0)


def optional(c: Column, test: Column) -> Column:
    """A rule that a missing value passes."""
    return c.isNull() | test


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the bookkeeping, quarantined rows with their errors)."""
    return validated.where("valid").drop("errors", "valid"), validated.where("not valid").drop("valid")


def rule_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("errors").alias("rule")).groupBy("rule").agg(F.count("*").alias("failures"))


def duplicates(df: DataFrame, key: list[Column], names: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*[k.alias(n) for k, n in zip(key, names)]).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose reference names no parent; missing references are not orphans."""
    ids = parents.select(F.col(parent_key).alias(key))
    return children.where(F.col(key).isNotNull()).join(ids, key, "left_anti")
