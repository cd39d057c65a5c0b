"""Reading raw requests and writing the log: Parquet, JSON, CSV, JDBC, files and Kafka as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..schema import LOG_ENTRY, RAW_REQUEST


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Raw requests with a fixed schema; nothing is inferred from untrusted input."""
    reader = spark.read.schema(RAW_REQUEST).options(**options)
    return reader.format(fmt).load(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Text files with one request body per line; file, body and the body's count in the file make the request id.

    Reading the same files again, with others or in other splits, gives the same ids.
    """
    lines = spark.read.text(path).select(F.col("value").alias("body"), "_metadata.file_path")
    # equal lines are counted map-side and numbered again, so a file of one repeated line is no group of rows
    counted = lines.groupBy("file_path", "body").agg(F.count("*").alias("n"))
    each = counted.select("file_path", "body", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i"))
    return each.select(F.sha2(F.concat_ws("|", "file_path", F.sha2("body", 256), F.col("i").cast("string")), 256).alias("request_id"), "body")


def stream_raw(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """File stream of raw requests; the trigger bound keeps micro-batches of even size."""
    return spark.readStream.schema(RAW_REQUEST).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 5_000_000) -> DataFrame:
    """Kafka stream of request bodies; topic, partition and offset make the request id.

    Needs the Kafka connector on the class path.
    """
    rows = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("maxOffsetsPerTrigger", offsets_per_trigger).load())
    return rows.select(
        F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("request_id"),
        F.col("value").cast("string").alias("body"), times.iso_millis(F.col("timestamp")).alias("received_at"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int = 64, **options: str) -> DataFrame:
    """Relational table read in ``parts`` ranges of a numeric column."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", column)
            .option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).options(**options).load())


def guarded_ts(timestamp: Column, received: Column) -> Column:
    """Event time that never runs ahead of its arrival: a client clock in 2099 cannot push a watermark."""
    arrived = received.try_cast("timestamp")
    return F.least(F.coalesce(times.event_ts(timestamp), arrived), arrived)


def with_partitions(entries: DataFrame, received: Column | None = None) -> DataFrame:
    """Add ``event_date``, the day partition of the log table: ``unknown`` where the time can't be read or runs ahead of the arrival."""
    ts = times.event_ts(F.col("timestamp"))
    day = F.when(ts <= received.try_cast("timestamp"), ts) if received is not None else ts
    return entries.withColumn("event_date", F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("unknown")))


def with_arrival_day(entries: DataFrame, received: Column) -> DataFrame:
    """Add ``event_date`` as the day of arrival, ``unknown`` where the entry's time can't be read or runs ahead of it.

    A day of arrival ends no earlier than its entries, so pruning by it loses none; and what clients claim makes no folders.
    """
    arrived = received.try_cast("timestamp")
    known = times.event_ts(F.col("timestamp")) <= arrived
    return entries.withColumn("event_date", F.when(known, F.date_format(arrived, "yyyy-MM-dd")).otherwise(F.lit("unknown")))


def append_entries(entries: DataFrame, path: str, max_records: int = 5_000_000) -> None:
    """Append rows to the log table as they are: no dedupe, no update.

    The rebalance hint gathers each partition's rows and splits oversized ones at run
    time. Files are sorted for range skipping and carry bloom filters on the lookup ids.
    """
    writer = (
        with_partitions(entries).hint("rebalance", "project_id", "event_date")
        .sortWithinPartitions("project_id", "event_date", "timestamp")
        .write.mode("append").partitionBy("project_id", "event_date").option("maxRecordsPerFile", max_records))
    for column in ("id", "trace_id", "request_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The written log. Its partition columns are texts, whatever their values look like: project ``007`` and the day ``unknown`` keep their names."""
    return spark.read.schema(f"{LOG_ENTRY}, event_date string").parquet(path)


def drop_partitions_before(entries: DataFrame, day: str) -> DataFrame:
    """Retention on the partition column: whole directories are skipped, no row is read."""
    return entries.where(F.col("event_date") >= day)
