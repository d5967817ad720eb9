"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_in_middle, html_text, language_id, mixing, packing, pii, simhash, token_alignment, token_counts, topk_search, toxicity, url_rules
from .common import small_batches, table


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; the files are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), byte_fallback=True)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).drop("loss_tokens")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[2]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, url_rules.RULES))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_alignment.digests(token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_topk_search": op3_topk_search,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_url_filters": op11_url_filters,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {"op3_topk_search": topk_search.SQL, "op4_exact_dedup": exact_dedup.SQL, "op11_url_filters": url_rules.SQL, "op13_fill_in_middle": fill_in_middle.SQL}
