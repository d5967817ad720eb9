"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A stage's result is written as Parquet and read again as the next one's docs.

Null and empty texts have no language and go in the first stage. Rows with null or equal ids are
told apart by their texts in every stage, repeated rows are reduced to one by the second. Empty
tables give empty results, and other columns come along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrain.llm import exact_dedup, language_id, mixing, packing, simhash
from pulsegrain.llm.common import small_batches, stored, table
from pulsegrain.llm.queries import tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined or has under half of the words go."""
    small_batches(spark)
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for runs of white space) the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its rate says, so that domains have their target shares."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json")).drop("loss_tokens")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: SQL has neither the language model nor the fingerprints; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, one after the other; each result but the last is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
