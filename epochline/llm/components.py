"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.session import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b): the least node that links lead to.

    Each round takes the least label among a node and its neighbours, then the label of that label, so
    that chains shorten by half. Labels are combined before the shuffle, so a node with many links
    sends one row per task. Every round is a table in the shared folder.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        hooked = labels.join(heard, labels["node"] == heard["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "low").alias("label")
        )
        hooked = settle(hooked, "hooked")
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = settle(hooked.join(above, "label").select("node", "old", F.least("label", "top").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            return labels
