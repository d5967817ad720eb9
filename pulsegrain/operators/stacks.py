"""Call trees folded from distinct stacks, with their budgets and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(stacks: DataFrame, frames: str, weights: list[str], keys: list[str] | None = None) -> DataFrame:
    """A node for each prefix of the frames: keys, path, depth, frame, the summed weights, stacks.

    stacks has one row for each distinct stack; sum the weights by stack first. Frames are taken
    in the order of the array: leaf first for callers, reversed for a flame tree.
    """
    keys = keys or []
    depth = F.explode(F.sequence(F.lit(1), F.size(frames)))
    prefixes = stacks.filter(F.size(frames) > 0).select(*keys, *weights, frames, depth.alias("depth"))
    prefixes = prefixes.withColumn("path", F.slice(frames, F.lit(1), F.col("depth")))
    nodes = prefixes.groupBy(*keys, "path", "depth").agg(*[F.sum(w).alias(w) for w in weights], F.count("*").alias("stacks"))
    return nodes.withColumn("frame", F.element_at("path", -1))


def ranked_siblings(nodes: DataFrame, weight: str, keys: list[str] | None = None) -> DataFrame:
    """Adds sibling (1 for the heaviest child of a parent) and before (weight of those ahead)."""
    parent = F.slice("path", F.lit(1), F.col("depth") - 1)
    w = Window.partitionBy(*(keys or []), "__parent").orderBy(F.desc(weight), "frame")
    ahead = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return nodes.withColumn("__parent", parent).withColumns({"sibling": F.row_number().over(w), "before": ahead}).drop("__parent")


def _up_the_path(nodes: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """A row for each node and each node on its path, itself included: columns come as up_<c>."""
    above = nodes.select(*keys, F.col("path").alias("up_path"), F.col("depth").alias("up_depth"), *[F.col(c).alias(f"up_{c}") for c in columns])
    each = nodes.withColumn("__d", F.explode(F.sequence(F.lit(1), F.col("depth")))).withColumn("up_path", F.slice("path", F.lit(1), F.col("__d"))).drop("__d")
    return each.join(above, [*keys, "up_path"])


def best_first(nodes: DataFrame, weight: str, cap: int, budget: int, keys: list[str] | None = None) -> DataFrame:
    """The nodes that a best-first walk shows: at most cap children of a node, budget nodes in all.

    Weights never grow towards the leaves, so the walk's nodes are the heaviest among those whose
    whole path lies within the caps. First-level nodes within the cap come in addition.
    """
    keys = keys or []
    marked = ranked_siblings(nodes, weight, keys)
    worst = _up_the_path(marked, ["sibling"], keys).groupBy(*keys, "path").agg(F.max("up_sibling").alias("worst"))
    allowed = marked.join(worst.filter(F.col("worst") <= cap).drop("worst"), [*keys, "path"])
    if not keys:  # a top list, of which each task only keeps its best
        inner = allowed.filter(F.col("depth") > 1).orderBy(F.desc(weight), "depth", "path").limit(budget)
        return allowed.filter(F.col("depth") == 1).unionByName(inner).drop("before")
    order = Window.partitionBy(*keys, "__top").orderBy(F.desc(weight), "depth", "path")
    placed = allowed.withColumn("__top", F.col("depth") == 1).withColumn("__n", F.row_number().over(order))
    return placed.filter(F.col("__top") | (F.col("__n") <= budget)).drop("__top", "__n", "before")


def depth_first(nodes: DataFrame, weight: str, cap: int, budget: int, keys: list[str] | None = None) -> DataFrame:
    """The first `budget` nodes of a pre-order walk that visits at most cap children, heaviest first."""
    keys = keys or []
    marked = ranked_siblings(nodes, weight, keys)
    up = _up_the_path(marked, ["sibling"], keys)
    steps = up.groupBy(*keys, "path").agg(F.array_sort(F.collect_list(F.struct("up_depth", "up_sibling"))).alias("__s"), F.max("up_sibling").alias("__worst"))
    steps = steps.filter(F.col("__worst") <= cap).select(*keys, "path", F.transform("__s", lambda s: s["up_sibling"]).alias("order"))
    walked = marked.join(steps, [*keys, "path"]).withColumn("visit", F.row_number().over(Window.partitionBy(*keys).orderBy("order")))
    return walked.filter(F.col("visit") <= budget).drop("before", "order")


def flame_layout(nodes: DataFrame, weight: str, keys: list[str] | None = None) -> DataFrame:
    """Adds x: the weight to the left of a node, which is what lies ahead on each level above."""
    keys = keys or []
    marked = ranked_siblings(nodes, weight, keys)
    x = _up_the_path(marked, ["before"], keys).groupBy(*keys, "path").agg(F.sum("up_before").alias("x"))
    return marked.join(x, [*keys, "path"]).drop("before", "sibling")


def self_and_total(stacks: DataFrame, frames: str, weight: str) -> DataFrame:
    """Weight of each frame as leaf and anywhere in a stack; a recursive frame counts once."""
    leaf = F.get(F.col(frames), 0)
    each = stacks.select(F.explode(F.array_distinct(frames)).alias("frame"), leaf.alias("__leaf"), weight)
    own = F.when(F.col("frame") == F.col("__leaf"), F.col(weight)).otherwise(0)
    return each.groupBy("frame").agg(F.sum(own).alias("self"), F.sum(weight).alias("total"))


def by_category(stacks: DataFrame, frames: str, weight: str, category) -> DataFrame:
    """Weight of each category as leaf, and of the stacks that hold it at all."""
    cats = F.when(F.size(frames) > 0, F.transform(frames, category)).otherwise(F.array(F.lit("Uncategorized")))
    named = stacks.withColumn("__cats", cats)
    each = named.select(F.explode(F.array_distinct("__cats")).alias("category"), F.get("__cats", 0).alias("__leaf"), weight)
    return each.groupBy("category").agg(F.sum(F.when(F.col("category") == F.col("__leaf"), F.col(weight)).otherwise(0)).alias("self"), F.sum(weight).alias("on_stack"))


def distinct_stacks(events: DataFrame, frames: str) -> DataFrame:
    """(stack_index, frames): one row per content; the index is a hash, checked to be unambiguous."""
    known = events.select(F.col(frames).alias("frames")).distinct().withColumn("hash", F.xxhash64("frames"))
    place = Window.partitionBy("hash").orderBy("frames")
    return known.select("hash", F.row_number().over(place).alias("nth"), "frames")
