"""Load times of compiled methods and collections that allocations belong to, over finished captures.

The same rows come from streaming.state while a capture runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import pair_start_stop


def jit_durations(events: DataFrame) -> DataFrame:
    """pid, method_id, seq, tier, tier_up and load_ms of each load that a start came before.

    events has pid, method_id, seq, kind (start, load), tier and ts_ms. A start before the load of
    an earlier one replaces it; a method that was loaded before is tiered up.
    """
    paired = pair_start_stop(events, ["pid", "method_id"], "seq", F.col("kind") == "start", F.col("kind") == "load", ["seq", "ts_ms", "tier"])
    nth = F.row_number().over(Window.partitionBy("pid", "method_id").orderBy("stop_seq"))
    return paired.select("pid", "method_id", F.col("stop_seq").alias("seq"), F.col("stop_tier").alias("tier"), (nth > 1).alias("tier_up"), (F.col("stop_ts_ms") - F.col("start_ts_ms")).alias("load_ms"))


def latest_collections(messages: DataFrame) -> DataFrame:
    """pid, seq, gc_id and bytes of each batch of allocations: the latest collection of its process before it, or null.

    messages has pid, seq, kind (gc, alloc), gc_id and bytes.
    """
    w = Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = messages.withColumn("latest", F.last(F.when(F.col("kind") == "gc", F.col("gc_id")), ignorenulls=True).over(w))
    return seen.filter("kind = 'alloc'").select("pid", "seq", F.col("latest").alias("gc_id"), "bytes")


def complete_collections(events: DataFrame) -> DataFrame:
    """pid, gc_id, seq, pause, heaps, alloc_bytes and alloc_ticks of each collection, at the event that completes it.

    events has pid, seq, kind (alloc, gc_start, heap, stats), gc_id and value: bytes of an
    allocation, number of heaps of a start, pause of statistics. A collection is complete once all
    its heaps and its statistics have come, in any order, unless another start came before; what
    comes after is left out. Allocations go with the collection that is completed next.
    """
    order = Window.partitionBy("pid").orderBy("seq")
    is_kind = lambda k: F.col("kind") == k
    start = F.last(F.when(is_kind("gc_start"), F.struct("seq", "gc_id", F.col("value").alias("expected"))), ignorenulls=True).over(order)
    own = events.withColumn("__s", start).filter((F.col("__s.gc_id") == F.col("gc_id")) & ~is_kind("alloc"))
    own = own.select("pid", "gc_id", "seq", "kind", "value", F.col("__s.seq").alias("start"), F.col("__s.expected").alias("expected"))
    within = Window.partitionBy("pid", "start").orderBy("seq")
    counted = own.withColumns({"heaps": F.count_if(is_kind("heap")).over(within), "pause": F.last(F.when(is_kind("stats"), F.col("value")), ignorenulls=True).over(within)})
    ready = counted.filter((F.col("kind") != "gc_start") & F.col("pause").isNotNull() & (F.col("heaps") >= F.col("expected")))
    done = ready.groupBy("pid", "start", "gc_id").agg(F.min_by(F.struct("seq", "pause", "heaps"), "seq").alias("x")).select("pid", "gc_id", "x.*")
    # each allocation meets the next completion of its process
    marks = done.select("pid", "seq", F.col("seq").alias("end"), F.lit(None).cast("double").alias("value"))
    both = marks.unionByName(events.filter(is_kind("alloc")).select("pid", "seq", F.lit(None).cast("bigint").alias("end"), "value"))
    ahead = Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sums = both.withColumn("next", F.first("end", ignorenulls=True).over(ahead)).filter("end IS NULL").groupBy("pid", F.col("next").alias("seq")).agg(F.sum("value").cast("bigint").alias("alloc_bytes"), F.count("*").alias("alloc_ticks"))
    return done.join(sums, ["pid", "seq"], "left").select("pid", "gc_id", "seq", "pause", "heaps", F.coalesce("alloc_bytes", F.lit(0)).alias("alloc_bytes"), F.coalesce("alloc_ticks", F.lit(0)).alias("alloc_ticks"))
