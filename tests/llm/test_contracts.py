"""What holds for each operator alike: empty tables, and other columns whose names clash with its own."""

import pytest
from pyspark.sql import functions as F

from pulsegrain.llm import exact_dedup, html_text, packing, pii, simhash, token_counts, topk_search
from pulsegrain.llm.queries import tokenizer_file

#: Names that the operators use inside.
NAMES = "id sha name hash pos block times nth kind key salt part lines kinds shared host path fp fingerprint bucket text_sha256 keep_id score rank n ids start length spans number segment".split()

DOCS = [(1, "One mail a@b.example now"), (2, "one  mail a@b.example now"), (3, None), (None, "x y z"), (3, "4111 1111 1111 1111")]

OPERATORS = {
    "op1": (lambda df: token_counts.token_counts(df, tokenizer_file("piece_bpe_32k.model")), DOCS, "doc_id long, text string"),
    "op2": (html_text.extract_text, [(1, "http://a.example/1", "<p>one<p>two"), (2, "http://a.example/2", "<p>one<p>three"), (None, None, None)], "page_id long, url string, html string"),
    "op3": (lambda df: topk_search.top_k(df, F.col("id") % 20 == 0), [(0, [0.5, 0.25]), (1, [0.1, 0.2]), (20, [0.3, 0.4]), (None, None)], None),
    "op4": (exact_dedup.exact_groups, DOCS, "doc_id long, text string"),
    "op5": (simhash.near_groups, DOCS, "doc_id long, text string"),
    "op7": (pii.find_pii, DOCS, "doc_id long, text string"),
    "op9": (lambda df: packing.pack(df, tokenizer_file("word_bpe_49k.json")), DOCS, "doc_id long, text string"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_clashing_columns(spark, sf, name):
    run, rows, schema = OPERATORS[name]
    if schema is None:
        schema = spark.read.parquet(f"{sf}/embeddings.parquet").schema
        plain = spark.createDataFrame([(*r, *[None] * (len(schema) - len(r))) if schema[0].name in ("id", "vec_id") else r for r in rows], schema)
    else:
        plain = spark.createDataFrame(rows, schema)
    wide = plain.withColumns({n: F.lit("clash") for n in NAMES if n not in plain.columns})
    assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(plain).collect()))
    empty = run(wide.limit(0))
    assert empty.count() == 0 and empty.columns == run(plain).columns
