"""Trace tables: Parquet in, canonical event columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts or aggregates at a time, however large the tables are.
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as `rows` take, at ROWS_A_TASK each and one for each core at least.

    The session's number of partitions and the sizes that it puts together make tasks grow with the
    table; these do not.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def relative_ms(df: DataFrame, micros: str, sync_micros: int | None = None) -> DataFrame:
    """Adds rel_ms since the capture's start; without a header the first event starts it."""
    if sync_micros is None:
        sync_micros = df.agg(F.min(micros)).first()[0] or 0
    return df.withColumn("rel_ms", (F.col(micros) - F.lit(sync_micros)) / F.lit(1000.0))


def ticks_to_ms(ticks: str, sync_ticks: str, frequency: str) -> F.Column:
    """Clock ticks as milliseconds since the sync point; a frequency of 0 or less gives 0."""
    return F.when(F.col(frequency) > 0, (F.col(ticks) - F.col(sync_ticks)) * 1000.0 / F.col(frequency)).otherwise(0.0)


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, us, rel_ms, tid, kind, value and k (from the JSON properties) of each event."""
    raw = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("user_id").alias("tid"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return relative_ms(raw, "us")


def allocations(events: DataFrame) -> DataFrame:
    """Purchases as allocation ticks: type_name, bytes, size class (0 small, 1 large, 2 pinned)."""
    ticks = events.filter("kind = 'purchase'")
    return ticks.select("seq", "rel_ms", "tid", F.concat(F.lit("T"), F.col("k") % 20).alias("type_name"), F.floor(F.col("value") * 1000).alias("bytes"), (F.col("seq") % 3).cast("int").alias("size_class"), (F.col("k") % 4).alias("heap"))


def exceptions(events: DataFrame) -> DataFrame:
    """Errors as exceptions: type_name and message."""
    return events.filter("kind = 'error'").select("seq", "rel_ms", "tid", F.concat(F.lit("E"), F.col("k") % 60).alias("type_name"), F.concat(F.lit("m"), F.col("seq")).alias("message"))


def stacks_of_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as sampled stacks, leaf first: part type, brand, nation and region; weight is quantity."""
    line, part, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    place = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name"))
    # weights are summed by the keys of the dimensions before any name is joined
    sums = line.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"), F.count("*").alias("ticks"))
    named = sums.join(part, sums.l_partkey == part.p_partkey).join(supplier, sums.l_suppkey == supplier.s_suppkey).join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.groupBy(F.array("p_type", "p_brand", "n_name", "r_name").alias("frames")).agg(F.sum("weight").alias("weight"), F.sum("ticks").alias("ticks"))
