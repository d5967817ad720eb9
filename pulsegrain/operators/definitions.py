"""Definitions that hold until they are replaced, removed or flushed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import range_join


def epochs(events: DataFrame, flushes: DataFrame, order: str) -> DataFrame:
    """events with `epoch`, the number of flushes before them; a flush opens the epoch of its own place.

    Flushes are few against events: their intervals are made in one window over them alone, and
    events find theirs by a range join.
    """
    bounds = flushes.select(F.col(order).cast("bigint").alias("__from")).distinct()
    low = bounds.sparkSession.range(1).select(F.lit(-(1 << 62)).alias("__from"))
    w = Window.orderBy("__from")
    spans = bounds.unionByName(low).withColumns({"__to": F.coalesce(F.lead("__from").over(w), F.lit(1 << 62)), "epoch": (F.row_number().over(w) - 1).cast("bigint")})
    return range_join(events, spans, order, "__from", "__to").drop("__from", "__to")


def resolve(uses: DataFrame, definitions: DataFrame, order: str, keys: list[str], value: str, is_removal: str | None = None) -> DataFrame:
    """uses with `value` of the latest definition of their keys before them; null if there is none or it was removed.

    Put `epoch` among the keys for definitions that do not survive a flush, and leave it out for
    those that do. A definition counts from behind its own place in the order.
    """
    given = definitions.select(*keys, order, F.struct((F.lit(None) if is_removal is None else F.when(F.col(is_removal), F.lit(True))).alias("gone"), F.col(value).alias("v")).alias("__d"))
    rows = uses.withColumn("__d", F.lit(None).cast(given.schema["__d"].dataType)).withColumn("__use", F.lit(True)).unionByName(given.withColumn("__use", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order, F.desc("__use")).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("__last", F.last("__d", ignorenulls=True).over(w)).filter("__use")
    return seen.withColumn(value, F.when(F.col("__last.gone").isNull(), F.col("__last.v"))).drop("__d", "__use", "__last")
