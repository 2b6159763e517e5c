"""Connected components of a link table by minimum labels and pointer jumping; every step is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfolio.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node in ``links``; the label is the smallest node reachable.

    In each round a node takes the smallest label around it, then the label of that label, so long chains shorten by
    half or more. Aggregates combine on the map side, so a hub with many links is no single task. Nothing is collected but
    the number of changes.
    """
    both = stored(
        links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionAll(links.select(F.col(b), F.col(a))).distinct(), "links"
    )
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")),
                    "labels")
    while True:
        around = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels.node == around.x).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        lower = stored(lower, "lower")
        above = lower.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = stored(
            lower.join(above, lower.label == above.up, "left").select("node", "old", F.least("label", "up_label").alias("label")), "jumped"
        )
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
