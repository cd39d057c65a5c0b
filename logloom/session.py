"""Session settings the transforms rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime SQL settings; safe to apply to a session somebody else created.
RUNTIME_CONF = {
    # Event times are UTC text; parsing and formatting must not follow the host zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Objects with a repeated key keep the last value, as JSON clients expect.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Rank filters prune map-side up to the largest quota.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Merge session windows map-side before the shuffle: a hot trace ships few rows.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "logloom", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("LOGLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
