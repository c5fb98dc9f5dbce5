"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``links`` (a, b); the component is its smallest node.

    Every round each node takes the smallest label around it, then the label of that label (pointer jumping), so chains
    shorten geometrically. Each round is written to the shared folder; only a count reaches the driver. An empty table
    of links gives an empty result.
    """
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        around = (edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                  .agg(F.min("component").alias("near")))
        nearer = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        moved = materialise(nearer.join(jump, "via").select("node", F.least("via", "further").alias("component"), "old"))
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
