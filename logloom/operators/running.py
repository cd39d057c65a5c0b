"""Running sums inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def sums_before(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` and, by name, the sum of each value over the rows before it in its group.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over many tasks; each summed its own rows, and a
    part starts at the totals of the group's parts before it. Rows that tie in ``order`` stand in any order.
    """
    dealt = df.select("*", *(v.alias(f"_{k}") for k, v in values.items())).repartitionByRange(*group, *order)
    held = cut(dealt.withColumn("_part", F.spark_partition_id()))
    totals = held.groupBy(*group, "_part").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in values))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_at"),
                           *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_start") for k in values))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = held.select("*", *(F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)).alias(f"_{k}_inside") for k in values))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_at"))
    return local.join(starts, same).select(*df.columns, *((F.col(f"_{k}_start") + F.col(f"_{k}_inside")).cast("bigint").alias(k) for k in values))
