"""Garbage collections from their events, and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept
from .symbols import load_intervals

#: Suspend reasons that belong to a collection, and the one of a background collection's cycles.
FOR_GC, FOR_PREPARATION = 1, 6
BACKGROUND = 1
KINDS = ("start", "end", "suspend", "suspend_end", "restart", "heap_stats", "heap_history", "global_history")


def correlate(events: DataFrame) -> DataFrame:
    """One row for each collection that ended: capture, id, generation, reason, type, start_ms, end_ms, pause_ms, heap_size, heaps.

    events has capture, seq, rel_ms, kind (see KINDS), gc_id, generation, reason, type, value; the
    order is (rel_ms, seq). Rows of other kinds are left out first, and windows over a capture's GC
    events, a few for each collection, find what each event refers to:

    - a restart ends the pause of the collection that started last, if it is the first restart
      since; a later one adds to the open background collection, if a suspension for it came before;
    - global history goes to the collection that waits longest among those of its generation;
    - heap history goes to the collection of the last global history, a heap counts once;
    - heap statistics go to that collection, if it has none yet, else to the one that ended last.

    A pause begins with the suspension since the start before, or with the start. Without any
    restart it lasts to the end. Of collections with one id the last start counts, of their ends the
    last one.
    """
    order = Window.partitionBy("capture").orderBy("rel_ms", "seq")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    is_kind = lambda k: F.col("kind") == k
    last = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(prior)
    qualifies = is_kind("suspend") & F.col("reason").isin(FOR_GC, FOR_PREPARATION)
    placed = events.filter(F.col("kind").isin(*KINDS)).withColumn("pos", F.row_number().over(order))
    seen = kept(
        placed.withColumns(
            {
                "suspended": last(qualifies, F.struct("pos", "rel_ms", "reason")),
                "suspend_end": last(is_kind("suspend_end"), F.col("rel_ms")),
                "started": last(is_kind("start"), F.struct("pos", "gc_id")),
                "restarted": last(is_kind("restart"), F.col("pos")),
                "background": last(is_kind("start") & (F.col("type") == BACKGROUND), F.struct("pos", "gc_id")),
                "ended": last(is_kind("end"), F.col("gc_id")),
                "batch": last(is_kind("global_history"), F.col("pos")),
            }
        )
    )
    suspended_since = lambda c: F.col("suspended.pos") > F.coalesce(c, F.lit(0))
    began = F.when(suspended_since(F.col("started.pos")), F.col("suspended.rel_ms")).otherwise(F.col("rel_ms"))
    starts = seen.filter(is_kind("start")).select("capture", "gc_id", "pos", "generation", "reason", "type", F.col("rel_ms").alias("start_ms"), began.alias("began"), F.when(F.col("type") == BACKGROUND, F.col("suspend_end") - began).alias("own_pause"))
    latest = starts.groupBy("capture", "gc_id").agg(F.max_by(F.struct("pos", "generation", "reason", "type", "start_ms", "began", "own_pause"), "pos").alias("g")).select("capture", "gc_id", "g.*")
    ends = seen.filter(is_kind("end")).select("capture", "gc_id", F.col("pos").alias("end_pos"), F.col("rel_ms").alias("end_ms"))
    gcs = latest.join(ends, ["capture", "gc_id"], "left").groupBy(*latest.columns).agg(F.max_by("end_ms", F.when(F.col("end_pos") > F.col("pos"), F.col("end_pos"))).alias("end_ms"), F.min(F.when(F.col("end_pos") > F.col("pos"), F.col("end_pos"))).alias("end_pos"))
    gcs = kept(gcs)

    restarts = seen.filter(is_kind("restart"))
    first = F.col("started").isNotNull() & (F.col("restarted").isNull() | (F.col("restarted") < F.col("started.pos")))
    paused = restarts.filter(first).select("capture", F.col("started.gc_id").alias("gc_id"), F.col("rel_ms").alias("resumed"))
    more = restarts.filter(~first & F.col("background").isNotNull() & suspended_since(F.col("restarted")) & (F.col("suspended.reason") == FOR_PREPARATION))
    more = more.select("capture", F.col("background.gc_id").alias("gc_id"), F.col("pos").alias("at"), (F.col("rel_ms") - F.col("suspended.rel_ms")).alias("added"))
    more = more.join(gcs.select("capture", "gc_id", "end_pos"), ["capture", "gc_id"]).filter(F.col("end_pos").isNull() | (F.col("at") < F.col("end_pos")))

    key = F.concat_ws("|", "capture", "generation")
    waits = seen.filter(is_kind("start") | is_kind("global_history")).select(key.alias("key"), "capture", "pos", is_kind("global_history").alias("is_unload"))
    pairs = load_intervals(waits, "key", "pos", "is_unload").filter("unload IS NOT NULL").withColumn("capture", F.regexp_extract("key", r"^(.*)\|", 1))
    named = pairs.join(starts.select("capture", F.col("pos").alias("load"), "gc_id"), ["capture", "load"])
    batches = kept(named.select("capture", F.col("unload").alias("batch"), "gc_id"))
    told = seen.filter(is_kind("global_history")).select("capture", F.col("pos").alias("batch"), F.col("reason").alias("told")).join(batches, ["capture", "batch"])
    history = seen.filter(is_kind("heap_history")).select("capture", "batch", "value").join(batches, ["capture", "batch"])

    stats = seen.filter(is_kind("heap_stats")).select("capture", "pos", "batch", "value", F.col("ended").alias("ended_id"))
    known = gcs.select("capture", F.col("gc_id").alias("ended_id"), F.col("pos").alias("ended_start"))
    stats = stats.join(batches, ["capture", "batch"], "left").join(known, ["capture", "ended_id"], "left")
    stats = stats.select("capture", "pos", "value", F.col("gc_id").alias("first"), F.when(F.col("ended_start") < F.col("pos"), F.col("ended_id")).alias("second"))

    by = ["capture", "gc_id"]
    out = gcs.filter("end_pos IS NOT NULL")
    for found in (
        paused.groupBy(*by).agg(F.min("resumed").alias("resumed")),
        more.groupBy(*by).agg(F.sum("added").alias("added")),
        told.groupBy(*by).agg(F.first("told").alias("told")),
        history.groupBy(*by).agg(F.count_distinct("value").alias("heaps")),
        _assigned(stats),
    ):
        out = out.join(found, by, "left")
    pause = F.coalesce(F.col("resumed") - F.col("began"), "own_pause", F.when(F.col("added").isNull(), F.col("end_ms") - F.col("start_ms")), F.lit(0.0)) + F.coalesce("added", F.lit(0.0))
    return out.select("capture", F.col("gc_id").alias("id"), "generation", F.coalesce("told", "reason").alias("reason"), "type", "start_ms", "end_ms", pause.alias("pause_ms"), "heap_size", F.coalesce("heaps", F.lit(0)).alias("heaps"))


def _assigned(stats: DataFrame) -> DataFrame:
    """(capture, gc_id, heap_size): each row takes its first choice, or its second, if no earlier row has it.

    Rows propose, a collection keeps its earliest row, and those it turns away go to their second
    choice; with one order for all, the rounds end where taking turns would.
    """
    rows = kept(stats.withColumn("turned", F.when(F.col("first").isNull(), 1).otherwise(0)))
    while True:
        asks = rows.withColumn("gc_id", F.when(F.col("turned") == 0, F.col("first")).when(F.col("turned") == 1, F.col("second"))).filter("gc_id IS NOT NULL")
        best = asks.groupBy("capture", "gc_id").agg(F.min("pos").alias("best"), F.min_by("value", "pos").alias("heap_size"))
        away = asks.join(best, ["capture", "gc_id"]).filter(F.col("pos") > F.col("best")).select("capture", "pos", F.lit(1).alias("away"))
        away = kept(away)
        if away.isEmpty():
            return best.select("capture", "gc_id", "heap_size")
        rows = kept(rows.join(away, ["capture", "pos"], "left").withColumn("turned", F.col("turned") + F.coalesce("away", F.lit(0))).drop("away"))


def derived_generation(size: str, free_list: str, free_objects: str, pinned: str, survived: str) -> dict[str, Column]:
    """Object space, fragmentation, survivors and survival rate of a generation's counters."""
    space = F.col(size) - F.col(free_list) - F.col(free_objects)
    out = F.col(pinned) + F.col(survived)
    return {"obj_space": space, "fragmentation": F.col(free_list) + F.col(free_objects), "out": out, "surv_rate": F.when(space > 0, F.floor(out * 100 / space)).otherwise(0)}


def median_by_text(values: str) -> Column:
    """The middle value of an array sorted as text, as a viewer of the reference shows it."""
    as_text = F.transform(values, lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string")))
    return F.get(F.array_sort(as_text), F.floor(F.size(values) / 2).cast("int")).cast("double")
