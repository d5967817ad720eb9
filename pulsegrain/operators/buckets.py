"""Time histograms with dense grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def equal_width(value: Column, low: float, width: float, n: int) -> Column:
    """Bucket 0 .. n-1 of equal width; the largest value falls into the last one."""
    if width <= 0:
        return F.lit(0)
    return F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(n - 1)).cast("int")


def grid(spark: SparkSession, n: int) -> DataFrame:
    """A row for each bucket; there are as many as a chart has."""
    return spark.range(n).select(F.col("id").cast("int").alias("bucket"))


def span(df: DataFrame, column: str) -> tuple[float, float, int]:
    """(least, largest, rows) of a column."""
    row = df.agg(F.min(column), F.max(column), F.count(column)).first()
    return (row[0] or 0.0, row[1] or 0.0, row[2])


def histogram(df: DataFrame, column: str, measures: dict[str, Column], most: int = 100, fixed: int | None = None) -> DataFrame:
    """Measures in equal-width buckets from the least to the largest value, empty ones as 0.

    There are min(rows, most) buckets, or `fixed`.
    """
    low, high, rows = span(df, column)
    n = fixed or min(rows, most)
    if not n:
        return grid(df.sparkSession, 0).select("bucket", *[F.lit(0).alias(m) for m in measures])
    width = (high - low) / n
    sums = df.groupBy(equal_width(F.col(column), low, width, n).alias("bucket")).agg(*[c.alias(m) for m, c in measures.items()])
    return grid(df.sparkSession, n).join(F.broadcast(sums), "bucket", "left").fillna(0)


def series(df: DataFrame, column: str, name: str, k: int, most: int = 100, fixed: int | None = None) -> DataFrame:
    """(name, bucket, n) for the k most frequent names, in the buckets of `histogram` over all rows.

    Empty buckets are left out. Where all rows have one time there is no series, and no row.
    """
    low, high, rows = span(df, column)
    n = fixed or min(rows, most)
    if high <= low or not n:
        return df.limit(0).select(name, F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("n"))
    top = df.groupBy(name).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), name).limit(k).select(name)
    bucket = equal_width(F.col(column), low, (high - low) / n, n)
    return df.join(F.broadcast(top), name).groupBy(name, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def top_and_other(df: DataFrame, name: str, weight: str, k: int, other: str = "Other") -> DataFrame:
    """df with `series`: the name if it is one of the k heaviest, else `other`."""
    top = df.groupBy(name).agg(F.sum(weight).alias("__w")).orderBy(F.desc("__w"), name).limit(k).select(F.col(name), F.lit(True).alias("__top"))
    return df.join(F.broadcast(top), name, "left").withColumn("series", F.when(F.col("__top"), F.col(name)).otherwise(other)).drop("__top")


def downsample(df: DataFrame, time: str, value: str, most: int) -> DataFrame:
    """At most `most` rows: equal-width sums if there are more, empty buckets left out."""
    low, high, rows = span(df, time)
    if rows <= most:
        return df.select(F.row_number().over(Window.orderBy(time)).alias("bucket"), F.col(time).alias("start"), F.col(value).alias("total"))
    width = (high - low) / most
    bucket = equal_width(F.col(time), low, width, most)
    return df.groupBy(bucket.alias("bucket")).agg(F.sum(value).alias("total")).select("bucket", (F.lit(low) + F.col("bucket") * width).alias("start"), "total")
