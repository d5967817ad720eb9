"""Comparison of two captures by named metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(base: DataFrame, other: DataFrame, base_seconds: float, other_seconds: float) -> DataFrame:
    """name, status, count_change, rate_change (per second) and percent_change.

    Both sides have name, n and amount. Each amount is divided by its own capture's length; a
    length of 0 gives the rate 0. The percentage is null where the base has no amount.
    """
    a = base.select("name", F.col("n").alias("a_n"), F.col("amount").alias("a_amount"), F.lit(True).alias("in_a"))
    b = other.select("name", F.col("n").alias("b_n"), F.col("amount").alias("b_amount"), F.lit(True).alias("in_b"))

    def rate(amount: Column, seconds: float) -> Column:
        return F.coalesce(amount, F.lit(0.0)) / seconds if seconds > 0 else F.lit(0.0)

    change = F.coalesce("b_amount", F.lit(0.0)) - F.col("a_amount")
    return a.join(b, "name", "full_outer").select(
        "name",
        F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("matched").alias("status"),
        (F.coalesce("b_n", F.lit(0)) - F.coalesce("a_n", F.lit(0))).alias("count_change"),
        F.round(rate(F.col("b_amount"), other_seconds) - rate(F.col("a_amount"), base_seconds), 6).alias("rate_change"),
        F.when(F.col("a_amount") != 0, F.round(change * 100 / F.col("a_amount"), 6)).alias("percent_change"),
    )


def ranked(rows: DataFrame, n: int = 200) -> DataFrame:
    """The n rows with the largest change of rate, then of count."""
    return rows.orderBy(F.desc(F.abs("rate_change")), F.desc(F.abs("count_change")), "name").limit(n)
