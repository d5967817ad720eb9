"""The pipeline over small tables with nulls, repeated ids and clashing columns."""

import random
from collections import Counter, defaultdict

import pytest
from brute import components, fingerprint, normal
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrain.llm import packing
from pulsegrain.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(2)
    text = {k: " ".join(f"the {rng.choice('abcdefg')}{rng.randrange(500)}" for _ in range(150)) for k in range(4)}
    rows = [(None, text[0], "en", "s", 1), (None, text[1], "en", None, None), (9, text[2], None, "s", 1), (9, text[3], "en", "s", 1), (9, text[3] + " ", "en", "s", 1), (10**6, None, None, None, None), (None, "", "en", "s", 0), (10**6, "123 45", "en", "s", 6)]
    return base.unionByName(spark.createDataFrame(rows, base.schema)), text


def test_stages_keep_their_promises(spark, sf, docs):
    rows, own = docs
    rows = rows.withColumns({"__id": F.lit(1), "__sha": F.lit("x"), "__n": F.lit(2), "__text": F.lit("y"), "lang_pred": F.lit("z")})
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, sf)
        assert kept.columns == rows.columns
        before, after = ([r.text for r in x.select("text").collect()] for x in (rows, kept))
        if name == "language_id":
            assert not {None, "", "123 45"} & set(after) and len(after) > 0.9 * len(before)
        elif name == "exact_dedup":
            assert Counter(map(normal, after)) == Counter(set(map(normal, before)))
        elif name == "simhash_near_dedup":
            fps = [fingerprint(t) for t in before]
            assert len(after) == len(set(components(fps, lambda x, y: (x ^ y).bit_count() <= 4)))
            assert sum(t.strip() in set(own.values()) for t in after) == 4
        else:
            assert set(after) <= set(before) and max(Counter(after).values()) <= 12
        assert stage(spark, rows.limit(0), sf).count() == 0
        rows = spark.createDataFrame(kept.collect(), kept.schema)
    pieces = stages["packing"](spark, rows, sf)
    assert pieces.groupBy("doc_id", "start").count().count() > 0 and pieces.filter("length < 1").isEmpty()


def test_run_is_the_stages_in_a_row(spark, sf):
    total = corpus_pipeline.run(spark, sf).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert total.n > 0 and total.n / total.s > 512


def test_conversations_meet_three_limits(spark, sf):
    path = tokenizer_file("word_bpe_49k.json")
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    pieces = packing.pack_conversations(turns, path, segments=2, loss=512).collect()
    answers = turns.filter("role = 'assistant'").count()
    assert sum(r.start == 0 for r in pieces) == answers
    sums = defaultdict(lambda: [0, 0, 0])
    for r in pieces:
        x = sums[r.sequence_id]
        x[0], x[1], x[2] = x[0] + r.length, x[1] + 1, x[2] + r.loss_tokens
    assert all(t <= 2048 and s <= 2 and b <= 512 for t, s, b in sums.values())
    assert any(s == 2 for _, s, _ in sums.values()) and any(b == 512 for _, _, b in sums.values())
    odd = spark.createDataFrame([(None, 0, "user", "a", 1), (None, 1, "assistant", None, 1), (1, 0, "assistant", "b", 1), (1, 0, "assistant", "b", 1)], "conv_id long, turn long, role string, text string, start int")
    assert packing.pack_conversations(odd, path).count() == 3 and packing.pack_conversations(odd.limit(0), path).count() == 0


def test_near_copies_broadcast_no_keys(spark, sf):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": "72m"}  # a page takes up to 64 MB, the keys over 100
    for name, most in limits.items():
        spark.conf.set(name, most)
    try:
        assert corpus_pipeline.drop_near_copies(spark, docs, sf).count() == 30_000
    finally:
        for name in limits:
            spark.conf.unset(name)
