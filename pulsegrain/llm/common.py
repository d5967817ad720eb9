"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: texts are long, so batches stay small.
ARROW_ROWS = "512"

ASCII_SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker: few rows of long text in each batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


@cache
def _local_folder() -> str:
    """One folder for a local process, which goes with it."""
    made = tempfile.mkdtemp(prefix="pulsegrain-checkpoint-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all machines share.

    Only a local session, as in tests, may leave it unset and has one made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared checkpoint folder and reads it from there."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """An inner join of many rows with few: rows of one key on the left are dealt over `salts` tasks, those on the right copied to each."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts).cast("long")))
    return dealt.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [*on, "__salt"]).drop("__salt")


def whole_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one column __row, whatever its columns are named, beside the given ones."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[x.alias(name) for name, x in more.items()])


def remainder_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def text_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each Arrow batch with one of its columns as Python strings, null as ''."""
    for batch in batches:
        yield batch, [t or "" for t in batch.column(column).to_pylist()]


def by_size(at: Iterable[int], texts: list[str], limit: int = 2_000_000) -> Iterator[list[int]]:
    """Runs of documents with up to `limit` characters together, or one longer document."""
    some: list[int] = []
    size = 0
    for i in at:
        if some and size + len(texts[i]) > limit:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(texts[i])
    if some:
        yield some
