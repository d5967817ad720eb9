"""Connected components of a sparse graph, with all its edges on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reached.

    Smallest labels spread over the edges and labels are replaced by the label of their label,
    so that long chains halve in each round. Only the number of changed labels goes to the driver.
    """
    both = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.node == near.u).select("node", "component", F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("upper"))
        new = low.join(up, "low").select("node", F.least("low", "upper").alias("new"), "component")
        new = cut_lineage(new)
        changed = new.filter("new <> component").limit(1).count()
        labels = new.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
