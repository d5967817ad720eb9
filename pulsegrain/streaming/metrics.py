"""Metrics of a live capture: gauges that keep the last value, and a counter, by their labels.

A table of metrics says from which columns a row sets which metric. `latest` is one aggregation, so
a batch and a stream (in update or complete mode) run the same code, and the state of a stream is a
row for each metric and label set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """One metric that a row sets to `value`; of a counter the values are added."""

    name: str
    value: str
    labels: tuple[str, ...]
    kind: str = "gauge"


_PROCESS = ("process_id", "process")
_COLLECTION = ("process_id", "gc_id")
_HEAP = ("process_id", "gc_id", "heap_index", "generation")

# What is reported of an allocation, a compiled method, a collection, and a generation of a heap.
ALLOCATION = (Metric("gc_alloc", "alloc_size", (*_PROCESS, "heap_index", "kind", "type_name")),)
METHOD = (Metric("jit_event", "load_time", (*_PROCESS, "is_tiered_up", "has_loaded", "method_id", "tier", "method_name")),)
COLLECTION_VALUES = (
    "gen_0_min_size", "loh_size", "gen_0_size", "gen_1_size", "gen_2_size", "pause_time_end_relative_msec", "pause_time_start_relative_msec", "pause_time_msec", "heap_size",
    "total_promoted", "loh_promoted", "gen_0_promoted", "gen_1_promoted", "gen_2_promoted",
)
HEAP_VALUES = (
    "size_before", "size_after", "obj_space_before", "free_list_space_before", "free_list_space_after", "free_obj_size_before", "free_obj_size_after", "obj_size_after", "fragmentation",
    "in", "out", "new_allocation_size", "survival_rate", "pinned_survival", "non_pinned_survival",
)
COLLECTION = (
    Metric("gc_collection_info", "pause_time_msec", (*_PROCESS, "gc_id", "generation", "kind", "reason", "type", "num_heaps")),
    Metric("gc_collection_count", "1", _PROCESS, "counter"),
    *[Metric(f"gc_collection_{v}", v, _COLLECTION) for v in COLLECTION_VALUES],
)
HEAP = tuple(Metric(f"gc_collection_heaps_{v}", v, _HEAP) for v in HEAP_VALUES)


def _label(name: str) -> Column:
    """name="value" with backslash, quote and line end escaped; null is empty."""
    text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit(f'{name}="'), text, F.lit('"'))


def samples(rows: DataFrame, metrics: tuple[Metric, ...], order: str = "seq") -> DataFrame:
    """(metric, kind, labels, order, value) for each row and metric; a null value sets nothing.

    Rows need the columns that the metrics name, and `order`, in which a later value replaces an
    earlier one.
    """
    each = [
        F.struct(F.lit(m.name).alias("metric"), F.lit(m.kind).alias("kind"), F.concat_ws(",", *[_label(n) for n in m.labels]).alias("labels"), (F.lit(1.0) if m.value == "1" else F.col(f"`{m.value}`").cast("double")).alias("value"))
        for m in metrics
    ]
    long = rows.select(F.col(order).cast("long").alias("order"), F.explode(F.array(*each)).alias("s"))
    return long.select("s.metric", "s.kind", "s.labels", "order", "s.value").filter("value IS NOT NULL")


def latest(samples: DataFrame) -> DataFrame:
    """(metric, kind, labels, value): a gauge's last value, a counter's sum. Of equal orders the larger value stays."""
    last = F.max(F.struct("order", "value"))["value"]
    return samples.groupBy("metric", "kind", "labels").agg(last.alias("last"), F.sum("value").alias("sum")).select("metric", "kind", "labels", F.when(F.col("kind") == "counter", F.col("sum")).otherwise(F.col("last")).alias("value"))


def exposition(values: DataFrame, prefix: str = "") -> DataFrame:
    """Lines of the text format of metrics; whole numbers have no point, others no power of ten from 0.0001 on."""
    size = F.abs("value")
    whole = (F.col("value") == F.floor("value")) & (size < 1e16)
    # a decimal has the digits of the double's shortest text; 17 of them fit behind the point
    plain = F.rtrim(F.col("value").cast("decimal(38,21)").cast("string"), F.lit("0"))
    number = F.when(whole, F.col("value").cast("long").cast("string")).when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.col("value").cast("string"))
    return values.select("metric", F.concat(F.lit(prefix), F.col("metric"), F.lit("{"), F.col("labels"), F.lit("} "), number).alias("line"))


def publish(stream: DataFrame, path: str, checkpoint: str, prefix: str = ""):
    """Starts a query that keeps the metrics of a stream of samples as text below `path`, whole after each batch.

    A folder of its own for each batch: one that is run again replaces what it wrote, and readers of
    the batch before are not disturbed.
    """

    def write(batch: DataFrame, nth: int) -> None:
        exposition(batch, prefix).select("line").write.mode("overwrite").text(f"{path}/batch={nth}")

    return latest(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
