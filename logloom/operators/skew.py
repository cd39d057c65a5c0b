"""Joins that survive one key holding a third of the rows, and filters by the keys of another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key of so many rows is split, into parts of about so many rows.
HOT_ROWS = 1_000_000
# The sketch tracks so many keys: one of more than about 1/75,000 of the rows is never missed. At most HOT_KEYS are split, the heaviest first.
TRACKED = 100_000
HOT_KEYS = 10_000
PARTS = 10_000
# Bits of a key filter: 2 MB whatever the number of keys.
FILTER_BITS = 1 << 24


def hot_keys(rows: DataFrame, on: list[str], min_rows: int = HOT_ROWS, weights: DataFrame | None = None) -> DataFrame:
    """Hashes of the heavy keys and into how many parts to split each: at most ``HOT_KEYS`` rows, so safe to broadcast.

    One pass over the key columns feeds a mergeable sketch of frequent items; only sketches are exchanged, rows are not grouped by key.
    ``weights`` (the key and ``_rows``, an upper bound of its rows) saves the pass.
    """
    key = F.xxhash64(*on)
    if weights is None:
        names = ", ".join(f"`{c}`" for c in on)
        top = rows.agg(F.expr(f"approx_top_k(xxhash64({names}), {HOT_KEYS}, {TRACKED})").alias("top")).select(F.explode("top").alias("x"))
        heavy = top.select(F.col("x.item").alias("_hash"), F.col("x.count").alias("_rows")).where(F.col("_rows") >= min_rows)
    else:
        heavy = weights.where(F.col("_rows") >= min_rows).select(key.alias("_hash"), "_rows").orderBy(F.desc("_rows"), "_hash").limit(HOT_KEYS)
        # two keys may share a hash
        heavy = heavy.groupBy("_hash").agg(F.sum("_rows").alias("_rows"))
    return heavy.select("_hash", F.least(F.lit(PARTS), F.greatest(F.lit(2), F.ceil(F.col("_rows") / min_rows))).cast("int").alias("_parts"))


def salted_join(big: DataFrame, few: DataFrame, on: list[str], how: str = "inner",
                row_key: Column | None = None, min_rows: int = HOT_ROWS, weights: DataFrame | None = None) -> DataFrame:
    """Equi-join where ``big`` may be skewed and ``few`` has few rows per key.

    Rows of a hot key are spread over its parts by a hash of the row; the matching rows
    of ``few`` are repeated once per part. Cold keys are untouched, so
    the result is that of the plain join. ``how`` is inner, left, left_semi or left_anti.
    """
    hot = F.broadcast(hot_keys(big, on, min_rows, weights))
    spread = row_key if row_key is not None else F.xxhash64(*big.columns)
    key = F.xxhash64(*on)
    left = big.withColumn("_hash", key).withColumn("_spread", spread).join(hot, "_hash", "left").withColumn(
        "_salt", F.when(F.col("_parts").isNotNull(), F.pmod("_spread", "_parts").cast("int")).otherwise(0)).drop("_hash", "_parts", "_spread")
    right = few.withColumn("_hash", key).join(hot, "_hash", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hash", "_parts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def key_filter(keys: DataFrame, on: list[str]):
    """A test for rows that may hold a key of ``keys``, to be used in a scan before rows are ranked or shuffled.

    The keys' hashes are set as bits of a field of fixed size, an aggregate that is combined in every task; the field reaches the
    scan as a scalar. A key that stands in ``keys`` always passes, others do by chance, more the fuller the field is. Returns a function from
    the key's columns to a condition; null keys never pass.
    """
    def place(columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))

    at = place([F.col(c) for c in on])
    present = keys.where(" and ".join(f"`{c}` is not null" for c in on))
    words = present.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("i"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("bit"))
    set_bits = words.groupBy("i").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(FILTER_BITS // 64).withColumnRenamed("id", "i").join(set_bits, "i", "left")
    field = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))), lambda x: x["bits"])).scalar()

    def may_hold(*columns: Column) -> Column:
        here = place(list(columns))
        held = F.getbit(F.get(field, F.shiftright(here, 6).cast("int")), here.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1
        for c in columns:
            held &= c.isNotNull()
        return held

    return may_hold
