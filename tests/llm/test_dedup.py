import random

import numpy as np
import xxhash
from brute import components, fingerprint, normal
from pyspark.sql import functions as F

from pulsegrain.llm import exact_dedup, simhash
from pulsegrain.llm.components import components as spark_components

TEXTS = [
    (1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, " "), (6, "\n\n"), (7, "é😀 x" * 40), (8, "é😀 x" * 40), (9, "x"), (9, "x"), (9, "y"), (None, "a b c"), (None, "only null"), (10, "x" * 5000), (11, "x" * 5001), (12, "x" * 5000),
]
SCHEMA = "doc_id long, text string, name string, pos int, block string, hash string, fp long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, "b", "h", 0) for i, t in rows], SCHEMA)


def expected_groups(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if normal(u) == normal(t)]
        ids = [j for j in same if j is not None]
        out.append((i, min(ids) if ids else None, len(same)))
    return sorted(out, key=str)


def test_groups_at_every_block_size(spark):
    for size in (1, 3, 16384):
        got = exact_dedup.exact_groups(frame(spark, TEXTS), block_bytes=size).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == expected_groups(TEXTS)
        # one row of each group stays
        assert sum(r.kept for r in got) == len({normal(t) for _, t in TEXTS})


def test_repeats_come_back_step_by_step(spark):
    rows = frame(spark, [(1, "a"), (2, " b")]).crossJoin(spark.range(2500)).drop("id")
    for step in (1, 1000, 2500, 10_000):
        got = exact_dedup.exact_groups(rows, repeats_step=step)
        assert sorted(map(tuple, got.groupBy("doc_id", "keep_id", "group_size").agg(F.count("*"), F.count_if("kept")).collect())) == [(1, 1, 2500, 2500, 1), (2, 2, 2500, 2500, 1)]


def test_clashing_hashes_are_told_apart_by_content(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(len(c)).cast("long"))
    got = exact_dedup.exact_groups(frame(spark, TEXTS), block_bytes=4).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == expected_groups(TEXTS)


def test_drop_copies_keeps_columns_and_one_row(spark):
    kept = exact_dedup.drop_copies(frame(spark, TEXTS))
    assert kept.columns == frame(spark, TEXTS).columns
    assert kept.count() == len({normal(t) for _, t in TEXTS})
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def near_texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(12):
        words = [rng.choice(vocabulary) for _ in range(300)]
        for n in range(12):
            copy = list(words)
            for _ in range(n % 4):
                copy[rng.randrange(300)] = "changed"
            rows.append((100 * k + n, " ".join(copy)))
    return rows + [(5000, None), (5001, ""), (5002, "One"), (5003, "one"), (5004, "a b c"), (None, "one")]


def test_fingerprints_and_components(spark):
    rows = near_texts()
    got = simhash.near_groups(frame(spark, rows)).collect()
    fps = [fingerprint(t) for _, t in rows]
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=str) == sorted(((i, f"{f:016x}") for (i, _), f in zip(rows, fps, strict=True)), key=str)
    root = components(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, least.get(r)) for (i, _), r in zip(rows, root, strict=True)), key=str)


def test_links_of_random_fingerprints_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    root = components(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    want = {}
    for s, r in zip(signed, root, strict=True):
        want.setdefault(r, set()).add(s)
    want = sorted(sorted(g) for g in want.values() if len(g) > 1)
    for block in (4096, 4):  # small blocks deal a key to many tasks
        got = {}
        for r in spark_components(simhash.fingerprint_links(df, block)).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert sorted(sorted(g) for g in got.values()) == want


def test_candidate_keys_are_never_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        links = simhash.fingerprint_links(spark.range(2000).select(F.xxhash64("id").alias("fp")).distinct())
        links.collect()
        plan = links._jdf.queryExecution().executedPlan().toString()  # as it ran
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pigeonring_loses_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        diff = np.uint64(0)
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            diff |= np.uint64(1) << np.uint64(bit)
        assert simhash._ring_ok(np.full(16, diff), np.arange(16)).any()


def test_shingle_hash_is_spark_s(spark):
    text = "Some Words to Hash"
    row = spark.range(1).select(F.xxhash64(F.lit(text.lower())).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(text.lower().encode(), 42) == simhash.fingerprint(text)


def test_drop_near_copies_keeps_one_of_each(spark):
    kept = simhash.drop_near_copies(frame(spark, near_texts()))
    groups = simhash.near_groups(frame(spark, near_texts())).select("component_id").distinct().count()
    assert kept.count() == groups


def test_drop_near_copies_tells_null_and_equal_ids_apart(spark):
    rng = random.Random(9)
    text = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(200)) for _ in range(6)]
    rows = [(1, text[0]), (2, text[1])]
    rows += [(None, text[0]), (None, text[2]), (None, text[3]), (None, text[3] + " "), (None, text[4]), (None, text[4])]  # a copy of 1, and three texts
    rows += [(7, text[1]), (7, text[5])]  # a copy of 2, and a text of its own
    for order in (rows, rows[::-1]):
        kept = sorted(((r.doc_id, r.text.strip()) for r in simhash.drop_near_copies(frame(spark, order)).collect()), key=str)
        assert kept == sorted([(1, text[0]), (2, text[1]), (None, text[2]), (None, text[3]), (None, text[4]), (7, text[5])], key=str)
