"""Live traces on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GC_STATE = "gc_id long, expected int, heaps int, stats boolean, pause double, alloc_bytes long, alloc_ticks long"
GC_OUT = "pid long, gc_id long, pause double, heaps int, alloc_bytes long, alloc_ticks long"


def assemble_gcs(events: DataFrame) -> DataFrame:
    """A row for each collection once all its heaps and its statistics have come, in any order.

    events has pid, seq, kind (alloc, gc_start, heap, stats), gc_id and value: bytes of an
    allocation, number of heaps of a start, pause of statistics. Allocations since the last
    complete collection go with the one that is completed next, to which a listener posts them;
    messages that name no collection go with the latest one, see state.latest_collections.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gc_id, expected, heaps, stats, pause, size, ticks = state.get if state.exists else (None, 0, 0, False, 0.0, 0, 0)
        out = []
        for e in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            if e.kind == "alloc":
                size, ticks = size + int(e.value), ticks + 1
            elif e.kind == "gc_start":
                gc_id, expected, heaps, stats, pause = int(e.gc_id), int(e.value), 0, False, 0.0
            elif gc_id is not None and e.gc_id == gc_id:
                if e.kind == "heap":
                    heaps += 1
                else:
                    stats, pause = True, float(e.value)
                if stats and heaps >= expected:
                    out.append((key[0], gc_id, pause, heaps, size, ticks))
                    gc_id, expected, heaps, stats, pause, size, ticks = None, 0, 0, False, 0.0, 0, 0
        state.update((gc_id, expected, heaps, stats, pause, size, ticks))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in GC_OUT.split(", ")])

    return events.groupBy("pid").applyInPandasWithState(step, GC_OUT, GC_STATE, "append", GroupStateTimeout.NoTimeout)


def event_rates(events: DataFrame, width: str = "1 minute", late: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events of each kind in tumbling windows, or sliding ones that begin every `slide`.

    A stream leaves out rows later than the watermark; route_late keeps them.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "kind").agg(F.count("*").alias("n")).select("w.start", "kind", "n")


def late_rows(events: DataFrame, time: str, order: str, late: int, cell: int = 100_000) -> DataFrame:
    """Rows that came behind the watermark of their place in the order, with late_us, how far behind.

    The watermark is the latest time before a row less `late`. Cells of the order are walked in
    parallel, each from the latest time of the cells before it.
    """
    rows = events.withColumn("__cell", F.floor(F.col(order) / cell))
    # a row for each cell is left
    cells = rows.groupBy("__cell").agg(F.max(time).alias("__latest"))
    before = cells.select("__cell", F.max("__latest").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)).alias("__start"))
    own = F.max(time).over(Window.partitionBy("__cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    seen = rows.withColumn("__own", own).join(F.broadcast(before), "__cell")
    mark = F.greatest("__own", "__start") - late
    return seen.withColumn("late_us", mark - F.col(time)).filter("late_us > 0").drop("__cell", "__own", "__start")


def route_late(stream: DataFrame, on_time: str, behind: str, marks: str, checkpoint: str, late_us: int):
    """Starts a query that appends rows to one of two tables: those on time, and those behind the watermark with late_us.

    stream has ts. The watermark is the latest time of the batches before less late_us. A batch
    writes folders of its own, so one that is run again after a failure replaces what it wrote; no
    row is lost, and the tables together are the stream.
    """

    def write(batch: DataFrame, nth: int) -> None:
        spark = batch.sparkSession
        known = [f"{marks}/batch={k}" for k in range(nth)]
        mark = spark.read.parquet(*known).agg(F.max("latest")).first()[0] if known else None
        us = F.unix_micros("ts")
        rows = batch.withColumn("late_us", F.lit(None).cast("long") if mark is None else F.lit(mark - late_us) - us)
        is_late = F.coalesce(F.col("late_us") > 0, F.lit(False))
        rows.filter(is_late).write.mode("overwrite").parquet(f"{behind}/batch={nth}")
        rows.filter(~is_late).drop("late_us").write.mode("overwrite").parquet(f"{on_time}/batch={nth}")
        rows.agg(F.max(us).alias("latest")).write.mode("overwrite").parquet(f"{marks}/batch={nth}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a process's events that no gap parts."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "pid").agg(F.count("*").alias("n")).select("pid", "w.start", "w.end", "n")


def snapshots(stream: DataFrame, report: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str = "10 seconds"):
    """Starts a query that overwrites a report with that of each batch."""

    def write(batch: DataFrame, _: int) -> None:
        report(batch).write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def gauges(batch: DataFrame) -> DataFrame:
    """A batch of collections as text lines of metrics, one for each process and measure."""
    sums = batch.groupBy("pid").agg(F.count("*").alias("gc_count"), F.sum("pause").alias("gc_pause_ms"), F.sum("alloc_bytes").alias("alloc_bytes"))
    long = sums.select("pid", F.explode(F.create_map(*[x for c in ("gc_count", "gc_pause_ms", "alloc_bytes") for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
    return long.select(F.format_string('%s{pid="%d"} %s', "metric", "pid", F.col("value").cast("string")).alias("line"))
