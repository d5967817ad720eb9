"""Near-duplicates by SimHash with pigeonring filtering.

A fingerprint of 64 bits is cut into 16 segments that form a ring. If two fingerprints differ in
at most 4 bits, then by the pigeonring principle some chain of consecutive segments has, for each
of its prefixes of j segments, at most floor(j * 4 / 16) differing bits: none in the first 3
segments, at most 1 in the first 7 and at most 2 in the first 11. Candidates are fingerprints that
share the exact first 12 bits of such a chain and two of the four bytes that follow, one of them
among the first two; the whole chain is checked before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, text_batches, whole_rows
from .components import components

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
SEGMENTS, WIDTH = 16, 4
#: Which two of the four bytes behind the exact 12 bits are shared.
BYTE_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))
#: Shingles whose hashes are held at once.
PART = 65536
#: Members of a key that one task compares at once; larger keys are split into blocks.
BLOCK = 4096
#: Fingerprints whose keys one task makes.
PER_TASK = 16384


def fingerprint(text: str, words_in_shingle: int = SHINGLE_WORDS) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    set_bits, n = np.zeros(64, dtype=np.int64), 0
    while len(part := np.fromiter(islice(hashes, PART), dtype=np.uint64)):  # long texts go part by part
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sha: bool = False) -> DataFrame:
    """(id, fp) for each row of docs, from its whole text; fp is the fingerprint as a signed long.

    With sha, also column sha: the hash that tells texts of one id apart.
    """
    more = ["sha"] if sha else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            fps = np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64)), *map(batch.column, more)], names=["id", "fp", *more])

    kept = [_sha(text_col).alias(c) for c in more]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *kept).mapInArrow(run, ", ".join(["id long, fp long", *(f"{c} string" for c in more)]))


def _sha(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def _keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): the candidate keys of each fingerprint, as many as segments times byte pairs."""
    keys = []
    for s in range(SEGMENTS):
        low, high = s * WIDTH, 64 - s * WIDTH
        fp = F.col("fp")
        ring = fp if s == 0 else F.shiftrightunsigned(fp, low).bitwiseOR(F.shiftleft(fp, high))
        head = ring.bitwiseAND(F.lit(0xFFF))
        part = [F.shiftrightunsigned(ring, 12 + 8 * j).bitwiseAND(F.lit(0xFF)) for j in range(4)]
        for n, (x, y) in enumerate(BYTE_PAIRS):
            which = F.lit((s * len(BYTE_PAIRS) + n) << 28)
            keys.append(which.bitwiseOR(F.shiftleft(head, 16)).bitwiseOR(F.shiftleft(part[x], 8)).bitwiseOR(part[y]))
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _ring_ok(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from segment `start` stays within its budgets at 3, 7 and 11 segments."""
    shift = (start * WIDTH).astype(np.uint64)
    ring = np.where(shift == 0, diff, (diff >> shift) | (diff << ((np.uint64(64) - shift) % np.uint64(64))))
    ok = np.ones(len(diff), dtype=bool)
    for segments in range(1, SEGMENTS):
        mask = np.uint64((1 << (segments * WIDTH)) - 1)
        ok &= np.bitwise_count(ring & mask) <= segments * MAX_BITS // SEGMENTS
    return ok


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares the members of each key; frames come sorted by (key, left, right).

    Links that close no new connection within the task are not emitted: what goes on is a forest,
    never all pairs of a group.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        key = f["key"].to_numpy()
        unit = np.stack([key, f["left"].to_numpy(), f["right"].to_numpy()], axis=1)
        fp = f["fp"].to_numpy().view(np.uint64)
        block, one_block = f["block"].to_numpy(), unit[:, 1] == unit[:, 2]
        start = (key >> 28) // len(BYTE_PAIRS)
        run = np.concatenate([[0], np.cumsum((unit[1:] != unit[:-1]).any(axis=1))]) if len(f) else np.array([], dtype=int)
        found, seen = [], np.arange(len(f))
        for d in range(1, len(f)):
            seen = seen[: np.searchsorted(seen, len(f) - d)]
            seen = seen[run[seen] == run[seen + d]]
            if not len(seen):
                break
            # a unit of two blocks compares across them only; each block has a unit of its own
            i = seen[one_block[seen] | (block[seen] != block[seen + d])]
            diff = fp[i] ^ fp[i + d]
            near = np.bitwise_count(diff) <= MAX_BITS
            i, diff = i[near], diff[near]
            i = i[_ring_ok(diff, start[i])]
            for x, y in zip(fp[i].tolist(), fp[i + d].tolist(), strict=True):
                if (p := root(x)) != (q := root(y)):
                    parent[max(p, q)] = min(p, q)
                    found.append((x, y))
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    rest: pd.DataFrame | None = None
    for frame in frames:
        whole = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        last = whole[["key", "left", "right"]].iloc[-1] if len(whole) else None
        if last is None:
            continue
        open_unit = (whole["key"] == last["key"]) & (whole["left"] == last["left"]) & (whole["right"] == last["right"])
        rest, ready = whole[open_unit], whole[~open_unit]
        if len(ready):
            yield compare(ready)
    if rest is not None and len(rest):
        yield compare(rest)


def fingerprint_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of column fp as the links at MAX_BITS do."""
    # a fingerprint becomes 80 keys, so they are dealt into parts of a fixed number first
    keys = _keys(distinct.repartition(max(1, -(-distinct.count() // PER_TASK)), "fp"))
    counts = keys.groupBy("key").count().filter("count > 1")
    # Spark takes the keys to be as few as the fingerprints they come from, and would broadcast them
    shared = keys.hint("merge").join(counts, "key")
    blocks = F.ceil(F.col("count") / block).cast("int")
    placed = shared.select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"))
    units = placed.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "fp")
    dealt = units.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return dealt.mapInPandas(_links, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs.

    Rows are linked if their fingerprints differ in at most 4 bits; component_id is the smallest
    doc_id that links reach. Null and empty texts have fingerprint zero and are linked like any
    other. Null ids take part but are never a component_id, unless a component has no other id.
    Repeated rows each come back; an empty table gives an empty result.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col))
    named = _named(fps, F.col("id"))
    # read back from disk, both sides of the join are plain shuffles, whose hot keys Spark splits
    named = cut_lineage(named)
    least = cut_lineage(named.groupBy("component").agg(F.min("least").alias("component_id")))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(fps: DataFrame, row: Column) -> DataFrame:
    """(fp, least, component) for each different fingerprint; least is its smallest value of row."""
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min(row).alias("least")))
    labels = components(fingerprint_links(distinct))
    return distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id, of these the smallest hash of the text.

    All columns of docs come back. Null ids come last. Rows with null or equal ids are told apart
    by their texts; repeated rows (same id, same text) are reduced to one.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, sha=True))
    named = _named(fps, F.struct(F.col("id").isNull().alias("no_id"), "id", "sha"))
    keep = named.groupBy("component").agg(F.min("least").alias("least"))
    keep = cut_lineage(keep.select(F.col("least.id").alias("kept_id"), F.col("least.sha").alias("kept_sha")))
    keyed = whole_rows(docs, __id=F.col(id_col).cast("long"), __sha=_sha(text_col))
    same = keyed["__id"].eqNullSafe(keep["kept_id"]) & (keyed["__sha"] == keep["kept_sha"])
    stays = keyed.join(keep, same, "left_semi")
    if not fps.groupBy("id", "sha").count().filter("count > 1").isEmpty():
        stays = stays.dropDuplicates(["__id", "__sha"])
    return stays.select("__row.*")
