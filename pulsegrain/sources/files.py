"""Files that traces come in and results go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layouts import little_endian


def read_gcinfo(spark: SparkSession, path: str) -> DataFrame:
    """Collections of an XML export: numbers lose their thousands commas, a missing POH is 0."""
    raw = spark.read.format("xml").option("rowTag", "GCEvent").schema("Id string, Generation string, StartMs string, DurationMs string, Gen0Size string, LOHSize string, POHSize string").load(path)
    number = lambda c: F.coalesce(F.regexp_replace(c, ",", "").cast("double"), F.lit(0.0))
    rows = raw.select(number("Id").cast("long").alias("id"), number("Generation").cast("int").alias("generation"), number("StartMs").alias("start_ms"), number("DurationMs").alias("duration_ms"), *[number(f"{c}Size").cast("long").alias(f"{c.lower()}_size") for c in ("Gen0", "LOH", "POH")])
    return rows.withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))


#: Bytes of a record of a sidecar, and records that are cut at once.
TICK_BYTES, TICK_BLOCK = 12, 4096


def decode_ticks(contents: DataFrame, content: str = "content") -> DataFrame:
    """The rows of a table of sidecars, whose other columns stay, with place, ms and bytes of each record.

    Records are int ms and long bytes, little-endian; what is left behind the last whole one is no
    record. A content comes apart in blocks first, so no array grows with it, and blocks are dealt
    over tasks before their records are read.
    """
    others = [c for c in contents.columns if c != content]
    n = F.floor(F.length(content) / TICK_BYTES).cast("int")
    blocks = contents.withColumn("__n", n).filter("__n > 0").select(*others, content, "__n", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / TICK_BLOCK).cast("int"))).alias("__block"))
    size = F.least(F.lit(TICK_BLOCK), F.col("__n") - F.col("__block") * TICK_BLOCK)
    cut = blocks.select(*others, "__block", size.alias("__size"), F.hex(F.substring(F.col(content), F.col("__block") * (TICK_BLOCK * TICK_BYTES) + 1, size * TICK_BYTES)).alias("__h"))
    cut = cut.repartition("__block", F.xxhash64("__h"))
    records = cut.select(*others, F.col("__block"), F.posexplode(F.transform(F.sequence(F.lit(0), F.col("__size") - 1), lambda i: F.substring(F.col("__h"), i * 24 + 1, F.lit(24)))).alias("__at", "__r"))

    def whole(first: int, size: int):
        swapped = F.concat(*[F.substring("__r", first + 2 * k, 2) for k in reversed(range(size))])
        return F.conv(swapped, 16, -10).cast("long") if size == 8 else F.conv(swapped, 16, 10).cast("long")

    ms, place = whole(1, 4), F.col("__block").cast("long") * TICK_BLOCK + F.col("__at")
    return records.select(*others, place.alias("place"), F.when(ms >= 1 << 31, ms - (1 << 32)).otherwise(ms).alias("ms"), whole(9, 8).alias("bytes"))


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Allocation ticks (ms, bytes) of sidecar files of 12-byte records; a file is one row of up to 2 GB until it is cut."""
    return decode_ticks(spark.read.format("binaryFile").load(path).select("content")).select("ms", "bytes")


def encode_tick(ms: Column, size: Column) -> Column:
    """A tick as the bytes of its record, its time rounded half to even."""
    return F.concat(little_endian(F.bround(ms, 0).cast("long"), 4), little_endian(size, 8))


def write_ticks(ticks: DataFrame, path: str) -> None:
    """Ticks as Parquet, times rounded half to even."""
    ticks.select(F.bround("rel_ms", 0).cast("int").alias("ms"), F.col("bytes").cast("long")).write.mode("overwrite").parquet(path)


def write_document(parts: dict[str, DataFrame], path: str) -> None:
    """Each part of a result as a folder of JSON lines."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def census_report(census: DataFrame, rows: int = 200) -> DataFrame:
    """Lines of a text report, the largest types first."""
    top = census.orderBy(F.desc("retained"), "type").limit(rows)
    return top.select(F.format_string("%12d %12d %8d  %s", "retained", "exclusive", "n", "type").alias("line"))


LIVE = "pid long, seq long, kind string, gc_id long, value double, ts timestamp"


def stream_live(spark: SparkSession, path: str) -> DataFrame:
    """Events that a listener drops as JSON lines, as a stream in the form of streaming.live."""
    return spark.readStream.schema(LIVE).json(path)
