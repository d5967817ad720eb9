import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from pulsegrain.llm import packing, token_counts
from pulsegrain.llm.queries import tokenizer_file
from pulsegrain.llm.word_cache import WordCache

ODD = [
    None, "", " ", "\n\t", "a\x1cb c", "İstanbul ΣΑΣ Σ", "x<|endoftext|>y <|endoftext|>", "é ́a", "a b", "don't he'll 123 ４５", "a\x85b", "日本語 テキスト", "ﬁ ǅ", "İ̇x", "well... done!? (yes) 50%%%", "▁▁a", "☃☃☃ ☃a☃",
    "<unk> <s>", "<0x41>", "word " * 3000, "x" * 9000,
]


def frame(spark):
    rows = [(k, t, 7) for k, t in enumerate(ODD)] + [(None, "null id", 7), (3, "again", 7), (3, "again", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), rows


def test_counts_are_the_tokenizer_s(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    unigram = Tokenizer(models.Unigram(list(token_counts.vocabulary(path)), unk_id=0, byte_fallback=False))
    unigram.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    df, rows = frame(spark)
    want = sorted(((i, len(unigram.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=str)
    got = token_counts.token_counts(df, path).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want


def test_ties_take_the_longest_last_piece():
    pieces = (("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", 0.0), ("▁a", -1.0))
    counter = token_counts.CountOnlyViterbi(pieces)
    unigram = Tokenizer(models.Unigram(list(pieces), unk_id=0, byte_fallback=False))
    unigram.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice("aabbx ") for _ in range(12))
        assert counter(text)[0] == len(unigram.encode(text).ids)


def test_a_long_word_takes_little_memory():
    import tracemalloc

    pieces = (("<unk>", 0.0), *((c, -3.0) for c in "ab▁"), ("aab", -4.0), ("abba", -5.5), ("bab", -4.5))
    counter = token_counts.CountOnlyViterbi(pieces)
    rng = random.Random(6)
    word = "".join(rng.choice("ab") for _ in range(300_000))
    unigram = Tokenizer(models.Unigram(list(pieces), unk_id=0, byte_fallback=False))
    short = word[:2000]
    assert counter.count(short) == len(unigram.encode(short).ids)
    tracemalloc.start()
    counter.count(word)
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_pieces_cover_every_id_once(spark):
    path = tokenizer_file("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    df, rows = frame(spark)
    got = packing.pack(df, path).collect()
    want = sorted((np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for _, t, _ in rows), key=str)
    assert sorted(r.doc_id for r in got if r.doc_id is not None and r.start == 0) == sorted(i for i, _, _ in rows if i is not None)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t, _ in rows:
        if i in (None, 3):
            continue
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            piece = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(piece), len(ids))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.TOKENS and at & (at - 1) == 0
    assert sum(r.length for r in got) == sum(len(w) // 4 for w in want)


def test_three_limits_hold():
    for seed in range(30):
        rng = random.Random(seed)
        packer = packing.Packer(0, 64, 4, rng.choice([64, 20]), True)
        sizes = [rng.choice([1, 2, 3, 5, 40, 300]) for _ in range(150)]
        for k, n in enumerate(sizes):
            packer.add(packing.Item(k, bytes(4 * n), 0, rng.choice([0, 0, n // 2])))
            packer.flush(False)
        packer.flush(True)
        total, tokens, segments, loss = [0] * len(sizes), defaultdict(int), defaultdict(int), defaultdict(int)
        for doc, _, length, _, _, sequence, _, bearing in packer.rows:
            total[doc] += length
            tokens[sequence] += length
            segments[sequence] += 1
            loss[sequence] += bearing
        assert total == sizes and max(tokens.values()) <= 64 and max(segments.values()) <= 4 and max(loss.values()) <= packer.limits[2]


def test_whole_examples_stay_whole():
    packer = packing.Packer(0, 64, 4, 32, False)
    for k in range(40):
        packer.add(packing.Item(k, bytes(4 * (5 + k % 50)), 0, k % 50 - 20 if k % 50 > 25 else 0) if k % 50 <= 25 else packing.Item(k, bytes(4 * 30), 0, 10))
    packer.flush(True)
    assert len(packer.rows) == 40
    with pytest.raises(ValueError):
        packer.add(packing.Item(1, bytes(400), 0, 0))


def test_cache_stays_bounded():
    cache = WordCache(len, size=10)
    assert [cache[str(k)] for k in range(100)] == [len(str(k)) for k in range(100)]
    assert len(cache) <= 10 and len(cache.older) <= 10


def test_unknown_characters_fall_back_to_bytes(spark):
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("▁a", -1.5), ("b", -2.0)]
    counter = token_counts.CountOnlyViterbi(tuple(pieces), byte_fallback=True)
    in_bytes = [(f"<0x{b:02X}>", -100.0) for b in range(256)]
    unigram = Tokenizer(models.Unigram(pieces + in_bytes, unk_id=0, byte_fallback=True))
    unigram.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aab☃é😀x ") for _ in range(12))
        assert counter(text)[0] == len(unigram.encode(text).ids), text
    path = tokenizer_file("piece_bpe_32k.model")
    df, rows = frame(spark)
    plain = {(r.doc_id, r.n_chars): r.n_tokens for r in token_counts.token_counts(df, path).collect()}
    for r in token_counts.token_counts(df, path, byte_fallback=True).collect():
        assert r.n_tokens >= plain[r.doc_id, r.n_chars]
    assert token_counts.token_counts(df.limit(0), path, byte_fallback=True).count() == 0
