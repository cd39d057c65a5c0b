"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Every shard draws a score for a record's key, ``-ln(u) / weight`` with ``u`` in (0, 1) from a hash of key and shard; the
least score wins. A shard's draw does not depend on the other shards, so adding one moves only the records it wins itself.

Slots number a shard's records without gaps from 0. A shard may hold any number of records, so none is sorted whole: records
are ranked inside small buckets of a shard, and a bucket starts where the counts of the buckets before it end.

Defined results: a null key is a key of its own; a null text has no bytes (size 1, crc32 of no bytes: 0). Equal keys fall into
the same shard, and repeated rows get slots of their own. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .registry import query, table

SHARDS = 16
BUCKETS = 1024


def draw(key: Column, shard: int, seed: str = "shard") -> Column:
    """A number in (0, 1) that key and shard decide."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit("\u0000null")), F.lit(shard)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards of these weights; shards of no weight get nothing."""
    scores = [F.struct((-F.ln(draw(key, i)) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("a shard of positive weight is needed")
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def numbered(records: DataFrame, group: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``records`` and ``slot``, gapless from 0 in each group, without sorting a group whole.

    The bucket also takes the partition a row comes from, so equal rows are spread as well; ``records`` must not be
    recomputed in other partitions, so it is written to the checkpoint folder first.
    """
    spread = F.pmod(F.xxhash64(*order, F.spark_partition_id()), F.lit(buckets))
    held = cut(records.withColumn("_bucket", spread))
    sizes = held.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    ranked = held.withColumn("_rank", rank)
    return ranked.join(starts, [group, "_bucket"]).withColumn("slot", F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_start", "_rank")


def shard_records(docs: DataFrame, weights: list[float], grown: list[float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per record: key, ``size``, ``text_crc32``, ``shard`` under ``weights``, ``grown_shard`` under ``grown``, ``slot`` in the shard."""
    key, text = F.col(id_column), F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        key, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(key, weights).alias("shard"), shard_of(key, grown).alias("grown_shard"))
    return numbered(rows, "shard", [id_column, "text_crc32", "size"])


@query("op9_sharding")
def op9_sharding(spark: SparkSession, directory: str) -> DataFrame:
    """All documents into 16 shards of equal weight by key, and where a seventeenth would put them."""
    rows = shard_records(table(spark, directory, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
