"""Heap graphs from bulk events: nodes come with edge counts, edges by position only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _positions(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Adds the running sum of `count` before each row, in (block, pos) order.

    Blocks are summed in parallel; only a total for each block is ordered as a whole.
    """
    totals = rows.groupBy("block").agg(F.sum(count).alias("__total"))
    ahead = Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, "block").withColumn(name, F.col("__offset") + F.coalesce(F.sum(count).over(inside), F.lit(0))).drop("__offset")


def attach_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(address, target) of each edge: a node of edge_count n takes the next n edges.

    nodes has block, pos, address, edge_count; edges has block, pos, target. Raises if the numbers
    of promised and present edges differ, which means that events were lost.
    """
    promised = nodes.agg(F.sum("edge_count")).first()[0] or 0
    present = edges.count()
    if promised != present:
        raise ValueError(f"nodes promise {promised} edges, but {present} are there")
    first = _positions(nodes, "edge_count", "first").filter("edge_count > 0")
    slots = first.select("address", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("edge_count") - 1)).alias("place"))
    placed = _positions(edges.withColumn("one", F.lit(1)), "one", "place")
    return slots.join(placed.select("place", "target"), "place").drop("place")
