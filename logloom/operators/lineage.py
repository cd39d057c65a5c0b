"""Cutting lineage where one result feeds several branches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder the cluster names.

    The files outlive lost executors, and what follows does not repeat the work above.
    Only a local session may fall back to a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="logloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
