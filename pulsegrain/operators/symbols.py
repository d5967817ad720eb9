"""Addresses to names: as-of range joins and load intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt
from .temporal import range_join


def resolve(lookups: DataFrame, ranges: DataFrame, rows: int | None = None) -> DataFrame:
    """(address, t, name) for each distinct lookup.

    ranges has start, end, load, unload and name. Of the ranges that hold the address, one alive at
    the time goes first, then the one that starts last; without any the address is unresolved. With
    `rows`, about how many lookups there are, tasks grow in number with them.
    """
    each = lookups.select("address", "t")
    # equal lookups cost a task no memory, so they are dealt as they are
    distinct = (each if rows is None else dealt(each, rows, "address", "t")).distinct()
    met = range_join(distinct, ranges, "address", "start", "end", rows=rows)
    alive = (F.col("t") >= F.col("load")) & (F.col("t") < F.coalesce("unload", F.lit(float("inf"))))
    rank = F.struct(alive.cast("int").alias("alive"), "start", "name")
    # each lookup beside its matches, with no rank
    found = met.select("address", "t", rank.alias("rank"))
    both = found.unionByName(distinct.withColumn("rank", F.lit(None).cast(found.schema["rank"].dataType)))
    best = (both if rows is None else dealt(both, rows, "address", "t")).groupBy("address", "t").agg(F.max("rank").alias("rank"))
    unresolved = F.concat(F.lit("<unresolved 0x"), F.hex("address"), F.lit(">"))
    return best.select("address", "t", F.coalesce("rank.name", unresolved).alias("name"))


def load_intervals(events: DataFrame, key: str, order: str, is_unload: str) -> DataFrame:
    """Loads of each key with the unload that ends them, first in first out.

    An unload that no load is open for does nothing. With u unloads and l loads so far, those that
    counted are u less the largest excess u - l so far, so pairing is an equality on running counts.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumns({"u": F.sum(F.col(is_unload).cast("int")).over(w), "l": F.sum((~F.col(is_unload)).cast("int")).over(w)})
    runs = runs.withColumn("counted", F.col("u") - F.greatest(F.lit(0), F.max(F.col("u") - F.col("l")).over(w)))
    runs = runs.withColumn("before", F.coalesce(F.lag("counted").over(Window.partitionBy(key).orderBy(order)), F.lit(0)))
    loads = runs.filter(~F.col(is_unload)).select(key, F.col("l").alias("nth"), F.col(order).alias("load"))
    unloads = runs.filter(F.col(is_unload) & (F.col("counted") > F.col("before"))).select(key, F.col("counted").alias("nth"), F.col(order).alias("unload"))
    return loads.join(unloads, [key, "nth"], "left").select(key, "load", "unload")
