"""Heap snapshots: neighbours of gaps, occupancy, generations, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_neighbours(objects: DataFrame, large: int) -> DataFrame:
    """Free chunks of at least `large` bytes with the live objects before and after them.

    The one after must come before the next large chunk.
    """
    w = Window.partitionBy("segment").orderBy("address")
    live, gap = ~F.col("is_free"), F.col("is_free") & (F.col("size") >= large)
    before = F.last(F.when(live, F.col("address")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = objects.withColumn("previous", before).filter(live | gap)
    after = marked.withColumns({"__next": F.lead("address").over(w), "__free": F.lead("is_free").over(w)})
    return after.filter("is_free").select("segment", "address", "size", "previous", F.when(~F.col("__free"), F.col("__next")).alias("following"))


def generation_stats(objects: DataFrame) -> DataFrame:
    """Objects, live and free bytes and fragmentation of each generation."""
    free = F.sum(F.when(F.col("is_free"), F.col("size")).otherwise(0))
    return objects.groupBy("generation").agg(
        F.count_if(~F.col("is_free")).alias("objects"), F.sum(F.when(~F.col("is_free"), F.col("size")).otherwise(0)).alias("live_bytes"), free.alias("free_bytes"), F.round(free * 100.0 / F.sum("size"), 2).alias("fragmentation")
    )


def segment_occupancy(objects: DataFrame) -> DataFrame:
    live = F.sum(F.when(~F.col("is_free"), F.col("size")).otherwise(0))
    return objects.groupBy("segment").agg(F.round(live * 100.0 / F.sum("size"), 2).alias("occupancy"), F.count("*").alias("n"))


#: Least sizes of the ranges that free chunks are counted in; the last one is open-ended.
FREE_RANGES = (0, 1024, 8192, 85_000, 1_048_576)


def free_histogram(objects: DataFrame, ranges: tuple[int, ...] = FREE_RANGES) -> DataFrame:
    """generation, low, high, n and bytes of free chunks by size; high is the largest size of the range, -1 for the last."""
    low, high = F.lit(ranges[-1]), F.lit(-1)
    for k in range(len(ranges) - 2, -1, -1):
        inside = F.col("size") < ranges[k + 1]
        low, high = F.when(inside, ranges[k]).otherwise(low), F.when(inside, ranges[k + 1] - 1).otherwise(high)
    return objects.filter("is_free").groupBy("generation", low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def generation_prefix(objects: DataFrame) -> DataFrame:
    """The objects of each segment before the first one of another generation than its first object's."""
    w = Window.partitionBy("segment").orderBy("address")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = F.col("generation") != F.first("generation").over(so_far)
    return objects.withColumn("__other", other).withColumn("__passed", F.count_if("__other").over(so_far)).filter("__passed = 0").drop("__other", "__passed")


def block_runs(objects: DataFrame, pinned: str | None = None) -> DataFrame:
    """Maximal runs of live objects and of gaps in each segment, with the heaviest type of a run.

    With `pinned`, a flag of objects, also how many other types a run has and whether any object is.
    """
    w = Window.partitionBy("segment").orderBy("address")
    changed = F.coalesce((F.lag("is_free").over(w) != F.col("is_free")).cast("int"), F.lit(0))
    runs = objects.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w))
    flag = [] if pinned is None else [F.bool_or(pinned).alias("pinned")]
    types = runs.groupBy("segment", "run", "is_free", "type").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("address").alias("start"), *flag)
    more = [] if pinned is None else [(F.count("*") - 1).alias("other_types"), F.bool_or("pinned").alias("pinned")]
    return types.groupBy("segment", "run", "is_free").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("start").alias("start"), F.max_by("type", F.struct("bytes", "type")).alias("dominant"), *more)


def report(objects: DataFrame, bounds: tuple[int, ...], types: int) -> DataFrame:
    """One row with a heap's report as a nested JSON document.

    Totals, generations, sizes of free chunks between `bounds` (the open-ended bucket ends at -1)
    and the largest types. Each part is an aggregation whose few rows are gathered into one array.
    """
    live = ~F.col("is_free")
    sums = [F.count_if(live).alias("objects"), F.sum(F.when(live, F.col("size")).otherwise(0)).alias("live_bytes"), F.sum(F.when(~live, F.col("size")).otherwise(0)).alias("free_bytes")]
    generations = objects.groupBy("generation").agg(*sums)
    totals = generations.agg(*[F.sum(c).alias(c) for c in ("objects", "live_bytes", "free_bytes")])
    low, high = F.lit(bounds[-1]), F.lit(-1)
    for k in range(len(bounds) - 1, -1, -1):
        inside = F.col("size") < bounds[k]
        low, high = F.when(inside, bounds[k - 1] if k else 0).otherwise(low), F.when(inside, bounds[k]).otherwise(high)
    buckets = objects.filter("is_free").groupBy(low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    largest = objects.filter(live).groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "type").limit(types)
    listed = lambda df, *c: df.agg(F.array_sort(F.collect_list(F.struct(*c))).alias("x"))
    by_bytes = lambda a, b: F.when((a["bytes"] > b["bytes"]) | ((a["bytes"] == b["bytes"]) & (a["type"] < b["type"])), -1).otherwise(1)
    parts = [totals, listed(generations, "generation", "objects", "live_bytes", "free_bytes").withColumnRenamed("x", "generations"), listed(buckets, "low", "high", "n", "bytes").withColumnRenamed("x", "free_buckets")]
    parts.append(largest.agg(F.array_sort(F.collect_list(F.struct("type", "n", "bytes")), by_bytes).alias("largest_types")))
    names = ("objects", "live_bytes", "free_bytes", "generations", "free_buckets", "largest_types")
    # one row of each, put together
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    return whole.select(F.to_json(F.struct(*names)).alias("report"))
