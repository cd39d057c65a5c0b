"""Streaming ingest, windowed counts, sessions, duplicate suppression and first-seen alerts."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels
from ..operators import ingest
from ..operators.fixwork import with_fingerprint
from ..schema import LOG_COLUMNS, LOG_ENTRY
from ..sources.io import guarded_ts, with_arrival_day, with_partitions


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder; a local one only for local sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="logloom-stream-")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def run_available(stream: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Process what is there into Parquet and return the written table."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start(f"{folder}/data").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def ingest_stream(requests: DataFrame) -> DataFrame:
    """Raw request stream to log rows with their partition column; stateless."""
    return with_partitions(ingest.normalize_requests(requests))


# Days a task of the ingest writes side by side, each with a buffer of at most so many bytes.
OPEN_DAYS = 64
DAY_BUFFER = 8 << 20


def start_ingest(requests: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Start the ingest of a raw request stream: log rows and quarantined requests into one table, each source row read and parsed once.

    A micro-batch has a folder of its own, named by the checkpoint and the batch, and overwrites it whole: a batch that is run again after a
    failure writes nothing twice. Folders below are the kind and the day of arrival, so no client decides on their number. Read
    the parts by ``stored_entries`` and ``stored_quarantine``.

    A task writes its days side by side, so it holds a buffer a day and never its rows as a whole; past ``OPEN_DAYS`` days in one task
    the rest is sorted by day, on disk when need be.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        rows = with_arrival_day(ingest.outcomes(batch), F.col("received_at"))
        # the session of the stream, a copy of its own
        batch.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", OPEN_DAYS)
        rows.write.mode("overwrite").partitionBy("kind", "event_date").option("parquet.block.size", DAY_BUFFER).parquet(f"{out}/stream={name}/batch={number}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


_STORED = f"{LOG_ENTRY}, source_request string, received_at string, reason string, body string, stream string, batch bigint, kind string, event_date string"


def stored_entries(spark: SparkSession, out: str) -> DataFrame:
    """Log rows that ``start_ingest`` wrote, with ``event_date``."""
    return spark.read.schema(_STORED).parquet(out).where("kind = 'entry'").select(*LOG_COLUMNS, "event_date")


def stored_quarantine(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(out).where("kind = 'quarantine'").select(
        F.col("source_request").alias("request_id"), "received_at", "reason", "body")


def with_guarded_time(entries: DataFrame, received: str = "received_at") -> DataFrame:
    return entries.withColumn("event_ts", guarded_ts(F.col("timestamp"), F.col(received)))


def severity_windows(entries: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Severity counts per project and window over ``event_ts``; late rows are dropped past the watermark."""
    level = F.col("level")
    at = F.window("event_ts", width, slide) if slide else F.window("event_ts", width)
    counts = entries.withWatermark("event_ts", late).groupBy(at.alias("w"), "project_id").agg(
        F.count("*").alias("total"), F.count_if(level == "warning").alias("warnings"),
        F.count_if(level.isin(*levels.ERROR_LEVELS)).alias("errors"))
    return counts.select("project_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "warnings", "errors")


def trace_sessions(entries: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Bursts of one trace separated by quiet gaps; merged map-side before the shuffle."""
    traced = entries.where(F.coalesce("trace_id", F.lit("")) != "").withWatermark("event_ts", late)
    sessions = traced.groupBy(F.session_window("event_ts", gap).alias("w"), "project_id", "trace_id").agg(F.count("*").alias("entries"))
    return sessions.select("project_id", "trace_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "entries")


def client_hash() -> Column:
    """Identity of a resent entry: all columns but the assigned id, a missing value told from an empty one."""
    fields = [c for c in LOG_COLUMNS if c != "id"]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def suppress_duplicates(entries: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Opt-in: drop resent entries while the watermark remembers them."""
    marked = entries.withColumn("client_hash", client_hash()).withWatermark("event_ts", late)
    return marked.dropDuplicatesWithinWatermark(["project_id", "client_hash"]).drop("client_hash")


def first_seen(entries: DataFrame) -> DataFrame:
    """One row per (project, shape), at its first arrival. State grows with the shapes, not the rows."""
    shaped = with_fingerprint(entries.where(levels.fixable(F.col("level"))))
    return shaped.dropDuplicates(["project_id", "fingerprint"])
