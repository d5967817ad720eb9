"""Ranked tables with ties broken by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept


def top(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def per_group(df: DataFrame, group: list[str], by: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank; Spark cuts groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col(rank) <= n)


def share_of(df: DataFrame, part: str, total: float, name: str = "percent") -> DataFrame:
    """Adds a percentage of a total that is already known."""
    return df.withColumn(name, F.when(F.lit(total) > 0, F.round(F.col(part) * 100.0 / F.lit(total), 6)).otherwise(0.0))


def exact_quantile(df: DataFrame, column: str, fraction: float) -> float | None:
    """sorted[min(int(n * fraction), n - 1)], without bringing the values together.

    Only the number of rows in each range partition and one value go to the driver.
    """
    values = df.select(column).filter(F.col(column).isNotNull())
    n = values.count()
    if not n:
        return None
    at = min(int(n * fraction), n - 1)
    ordered = values.repartitionByRange(column).withColumn("__part", F.spark_partition_id())
    sizes = {r[0]: (r[1], r[2]) for r in ordered.groupBy("__part").agg(F.count("*"), F.min(column)).collect()}
    for _, (size, low) in sorted(sizes.items(), key=lambda x: x[1][1]):
        if at < size:
            high = min((m for _, (_, m) in sizes.items() if m > low), default=None)
            here = values.filter(F.col(column) >= low) if high is None else values.filter((F.col(column) >= low) & (F.col(column) < high))
            return here.orderBy(column).offset(at).limit(1).first()[0]
        at -= size
    return None


def grouped_quantiles(df: DataFrame, groups: list[str], column: str, places: dict[str, Column], spread: Column | None = None) -> DataFrame:
    """groups, n and one value for each of `places`, picked from the sorted non-null values of each group.

    places maps names to 0-based places as expressions of `n`, the number of the group's values. All
    groups are range-partitioned together by (group, value), so that a large group lies in many
    parts; counts by part and group tell in which part a place is, and only that part's rows of the
    group are numbered. spread, such as a row number, deals equal values over several parts.
    """
    values = df.filter(F.col(column).isNotNull()).select(*groups, F.col(column).alias("__v"), (F.lit(0) if spread is None else spread).alias("__s"))
    parts = kept(values.repartitionByRange(*groups, "__v", "__s").select(*groups, "__v", F.spark_partition_id().alias("__part")))
    # a row for each part and each group in it
    counts = parts.groupBy(*groups, "__part").agg(F.count("*").alias("__here"))
    order = Window.partitionBy(*groups).orderBy("__part")
    before = F.coalesce(F.sum("__here").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"__before": before, "n": F.sum("__here").over(Window.partitionBy(*groups))})
    wanted = counts.select(*groups, "__part", "n", "__before", "__here", F.explode(F.create_map(*[x for k, at in places.items() for x in (F.lit(k), at.cast("bigint"))])).alias("__name", "__at"))
    wanted = wanted.filter((F.col("__at") >= F.col("__before")) & (F.col("__at") < F.col("__before") + F.col("__here")))
    wanted = kept(wanted.select(*groups, "__part", "n", "__name", (F.col("__at") - F.col("__before")).alias("__at")))
    near = parts.join(wanted.select(*groups, "__part").distinct(), [*groups, "__part"], "left_semi")
    placed = near.withColumn("__at", (F.row_number().over(Window.partitionBy(*groups, "__part").orderBy("__v")) - 1).cast("bigint"))
    found = placed.join(wanted, [*groups, "__part", "__at"])
    return found.groupBy(*groups, "n").agg(*[F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in places])
