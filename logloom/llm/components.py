"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut


def least_labels(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """``node`` and ``label`` for every node of ``edges``: the least node that links reach.

    Each round takes the least label among the neighbours and then follows labels once (labels are nodes), so paths halve. With
    ``rounds`` it stops early; nodes of equal label are then certainly connected, others perhaps. Everything stays in Spark;
    each round is written to the checkpoint folder.
    """
    both = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct())
    labels = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label"))
    labels = cut(labels)
    done = 0
    while rounds is None or done < rounds:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = cut(step.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        labels = step.select("node", "label")
        done += 1
        if rounds is None and step.filter(F.col("label") != F.col("old")).isEmpty():
            break
    return labels
