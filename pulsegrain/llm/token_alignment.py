"""Alignment of two tokenizers over a corpus, each different segment tokenized once.

A text is cut before runs of white space, where no token of either vocabulary reaches across: the
cutter looks up in both vocabularies which pairs of characters stand beside each other in a token
and cuts between no such pair. So the tokens of a text are those of its segments one after the
other. Documents are dealt into blocks; a block keeps its different segments once and each
document as the numbers of its segments. Segments of all blocks meet by their text, are tokenized
and aligned once, and go back to their blocks, where the documents are composed.

The most frequent segments of a bounded sample have numbers of their own in all blocks. They are
aligned first and broadcast, at most FREQUENT segments of at most LONGEST characters; which ones
they are decides only what travels, never a result.

Counts of linked id pairs need a first pass over the blocks, which only counts; the second one
composes. Neither moves texts: documents travel as packed segment numbers.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache, reduce
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, stored, text_batches

SPACE, MARK = " ", "▁"
#: A link: which token ends with it (of the first vocabulary, the second, or both, where a group ends), and the two ids.
LINKS = np.dtype([("step", "u1"), ("a", "<u4"), ("b", "<u4")])
ONE_A, ONE_B, BOTH = 1, 2, 3
#: How many documents hold a pair, and whether that is its first id's highest number.
COUNT = ">QB"
#: Stands before a segment that begins with other white space; no piece may hold it beside others.
GUARD = "\0"
#: White space that a cut may stand before; both tokenizers agree on it.
CUT_BEFORE = " \t\n\v\f\r"
#: A block is closed at so many different segments of its own or characters.
BLOCK_SEGMENTS, BLOCK_CHARS = 200_000, 128_000_000
#: Segments that all blocks know, how long they may be, and the documents (of at most so many
#: characters) that they are chosen from, in expectation.
FREQUENT, LONGEST, SAMPLE, SAMPLE_CHARS = 200_000, 48, 10_000, 100_000
#: Segments that are tokenized at once, aligned ones that a task gathers by block before it hands them on, and documents that are composed at once.
BATCH, GATHERED, COMPOSED = 4096, 200_000, 512


class Vocabularies:
    """The two tokenizers, their tokens as bytes, and where texts may be cut."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        # a task has one core; threads for small batches cost more than they give
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, SPACE).encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        if pieces[self.mark] != MARK:
            raise ValueError("the second vocabulary has no piece for one space")
        if any(GUARD in p for p in pieces):
            raise ValueError("a piece of the second vocabulary holds the guard")
        self.guard = len(self.b.encode(GUARD))
        tokens = [t.decode("utf-8", "replace") for t in self.bytes_a.values()] + [b.decode("utf-8", "replace") for b in self.bytes_b]
        self.segment = _segments(tokens)

    def segments(self, text: str) -> list[str]:
        """Segments of space and text."""
        return self.segment.findall(SPACE + text)

    def tokens(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of each segment by both tokenizers, as they stand inside a text."""
        ids_a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        # this tokenizer puts a space before what it gets, which may join other white space
        ids_b = self.b.encode([s[1:] if s[0] == SPACE else GUARD + s for s in segments], num_threads=1)
        for s, x, y in zip(segments, ids_a, ids_b, strict=True):
            if s == SPACE:
                y = [self.mark]
            elif s[0] != SPACE:
                y = y[self.guard :]
            yield x, y

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each token of both vocabularies."""
        a = np.zeros(max(self.bytes_a) + 1, dtype=np.int64)
        for i, token in self.bytes_a.items():
            a[i] = len(token)
        return a, np.array([len(token) for token in self.bytes_b], dtype=np.int64)

    def align(self, segments: list[str]) -> list[bytes]:
        """For each segment the links of its tokens in order as LINKS records; none where the tokens do not give it back.

        Tokens of all segments lie on one line of bytes. Each end of a token of either vocabulary
        ends a link, whose tokens are those that reach up to there.
        """
        sources = [s.encode("utf-8", "surrogatepass") for s in segments]
        both = list(self.tokens(segments))
        same = self._given_back(both, sources)
        kept = [x for x, good in zip(both, same, strict=True) if good]
        if not kept:
            return [b""] * len(segments)
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in kept), dtype=np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        ends = np.union1d(ends_a, ends_b)
        links = np.empty(len(ends), dtype=LINKS)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links["a"], links["b"] = a[at_a], b[at_b]
        links["step"] = ONE_A * (ends_a[at_a] == ends) + ONE_B * (ends_b[at_b] == ends)
        whole = np.cumsum([len(t) if good else 0 for t, good in zip(sources, same, strict=True)])
        stops = (np.searchsorted(ends, whole, side="right") * LINKS.itemsize).tolist()
        packed = links.tobytes()
        return [packed[x:y] for x, y in zip([0, *stops], stops, strict=False)]

    def _given_back(self, both: list[tuple[list[int], list[int]]], sources: list[bytes]) -> list[bool]:
        """Which segments the tokens of both vocabularies give back byte for byte; all at once where all are."""
        known = (self.bytes_a, self.bytes_b)
        ends = np.cumsum(list(map(len, sources)))
        whole = b"".join(sources)

        def all_of(k: int) -> bool:
            ids = list(chain.from_iterable(x[k] for x in both))
            if b"".join(map(known[k].__getitem__, ids)) != whole:
                return False
            reached = np.append(0, np.cumsum(self.lengths[k][ids]))
            return bool((reached[np.cumsum([len(x[k]) for x in both])] == ends).all())

        if all_of(0) and all_of(1):
            return [True] * len(sources)
        return [b"".join(map(self.bytes_a.__getitem__, a)) == t == b"".join(map(self.bytes_b.__getitem__, b)) for (a, b), t in zip(both, sources, strict=True)]


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


def _segments(tokens: list[str]) -> re.Pattern:
    """A pattern of segments: each begins with white space that no token joins to what is before.

    No cut is made after white space of any kind, where tokenizers look ahead.
    """
    joined: dict[str, set[str]] = {}
    for t in tokens:
        for k in range(1, len(t)):
            if t[k] in CUT_BEFORE and not t[k - 1].isspace():
                joined.setdefault(t[k], set()).add(t[k - 1])
    kept = "".join(f"|(?<=[{re.escape(''.join(sorted(before)))}]){re.escape(space)}" for space, before in sorted(joined.items()))
    return re.compile(rf".(?:[^{CUT_BEFORE}]+|(?<=\s)[{CUT_BEFORE}]+{kept})*", re.S)


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers under 2**32, their bytes of one place side by side so that they compress."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


class Aligned:
    """Segments with their links one after the other: pairs, sums and groups."""

    def __init__(self, lengths: np.ndarray, links: np.ndarray):
        self.links, self.lossless = links, lengths > 0
        self.of = np.repeat(np.arange(len(lengths)), lengths)
        self.pairs = links["a"].astype(np.int64) << 32 | links["b"]

    @staticmethod
    def packed(numbers: list[int], bodies: list[bytes]) -> bytes:
        """Some segments of a block as one value: how many, their numbers, their links' numbers, the links."""
        lengths = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) // LINKS.itemsize
        head = np.concatenate([[len(bodies)], numbers, lengths]).astype("<u4")
        return head.tobytes() + b"".join(bodies)

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Aligned:
        """The segments of packed values, by number."""
        numbers, lengths, links = [], [], []
        for part in parts:
            n = int.from_bytes(part[:4], "little")
            head = np.frombuffer(part, dtype="<u4", count=2 * n, offset=4).astype(np.int64)
            numbers.append(head[:n])
            lengths.append(head[n:])
            links.append(np.frombuffer(part, dtype=LINKS, offset=4 + 8 * n))
        if not parts:
            return cls(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=LINKS))
        number, length, link = np.concatenate(numbers), np.concatenate(lengths), np.concatenate(links)
        order = np.argsort(number)
        starts, sorted_lengths = (np.cumsum(length) - length)[order], length[order]
        ends = np.cumsum(sorted_lengths)
        return cls(sorted_lengths, link[np.repeat(starts - ends + sorted_lengths, sorted_lengths) + np.arange(len(link))])

    def sums(self, holding: np.ndarray, best: np.ndarray) -> np.ndarray:
        """A row for each segment: tokens of both, groups, links, those whose count is the best, counts, and 1 if it is lost."""
        step = self.links["step"]
        each = [step & ONE_A > 0, step & ONE_B > 0, step == BOTH, np.ones(len(step)), best, holding]
        columns = [np.bincount(self.of, weights=x, minlength=len(self.lossless)) for x in each]
        return np.stack([*columns, ~self.lossless], axis=1).astype(np.int64)

    def groups(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each segment."""
        found = [""] * len(self.lossless)
        ids_a, ids_b, parts, last = [], [], [], BOTH
        for step, a, b, at in zip(self.links["step"].tolist(), self.links["a"].tolist(), self.links["b"].tolist(), self.of.tolist(), strict=True):
            if last & ONE_A:
                ids_a.append(str(a))
            if last & ONE_B:
                ids_b.append(str(b))
            last = step
            if step == BOTH:
                text = f"{','.join(ids_a)}|{','.join(ids_b)}"
                found[at] = f"{found[at]};{text}" if found[at] else text
                ids_a, ids_b = [], []
        return found


class Frequent:
    """The segments that all blocks know, by number, and their alignments as one packed value."""

    def __init__(self, segments: list[str], body: bytes):
        self.segments, self.body = segments, body

    @cached_property
    def numbers(self) -> dict[str, int]:
        return {s: k for k, s in enumerate(self.segments)}

    @cached_property
    def aligned(self) -> Aligned:
        return Aligned.unpacked([self.body])

    @cached_property
    def groups(self) -> list[str]:
        return self.aligned.groups()

    def __getstate__(self) -> tuple:
        return self.segments, self.body

    def __setstate__(self, state: tuple) -> None:
        self.segments, self.body = state


class Numbers(dict):
    """Numbers of segments; those that all blocks know come first, new ones follow and are listed."""

    def __init__(self, frequent: Frequent):
        super().__init__()
        self.frequent, self.new = frequent.numbers, []

    def __missing__(self, segment: str) -> int:
        number = self.frequent.get(segment)
        if number is None:
            number = len(self.frequent) + len(self.new)
            self.new.append(segment)
        self[segment] = number
        return number


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers under 2**32, their bytes of one place side by side so that they compress."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_CUT = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("document", pa.binary()), ("held", pa.binary()), ("number", pa.int64()), ("segment", pa.string())])
_SEGMENTS = pa.schema([("segment", pa.string()), ("n", pa.int64())])
_ALIGNED = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("body", pa.binary())])
_COUNTED = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("holding", pa.int64())])
_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_COMPOSED = pa.schema([(c, pa.int64()) for c in ("doc_id", *_SUMS)] + [("groups", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else f.type}" for f in schema)


def frequent_segments(docs: DataFrame, path_a: str, path_b: str, most: int, sample: int) -> Frequent:
    """The most frequent segments of about `sample` documents, aligned on Spark; at most `most` rows go to the driver."""
    share = min(1.0, sample / max(1, docs.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies(path_a, path_b)
        for batch, texts in text_batches(batches, "text"):
            seen = Counter(s for t in texts if t for s in words.segments(t) if len(s) <= LONGEST)
            yield _batch(list(seen.items()), _SEGMENTS)

    some = docs.select("text").sample(False, share, 7).filter(F.length("text") <= SAMPLE_CHARS)
    counts = some.mapInArrow(count, _ddl(_SEGMENTS)).groupBy("segment").agg(F.sum("n").alias("n")).filter("n > 1")
    top = cut_lineage(counts.orderBy(F.desc("n"), "segment").limit(most))
    order = [r.segment for r in top.orderBy(F.desc("n"), "segment").select("segment").toLocalIterator()]
    spread = docs.sparkSession.createDataFrame(pa.table({"number": pa.array(range(len(order)), pa.int64()), "segment": pa.array(order, pa.string())}))
    made = aligned(spread.withColumn("block", F.lit(0).cast("long")), path_a, path_b).toArrow()
    numbers, lengths, links = [], [], []
    for part in made.column("body").to_pylist():
        n = int.from_bytes(part[:4], "little")
        numbers.append(part[4 : 4 + 4 * n])
        lengths.append(part[4 + 4 * n : 4 + 8 * n])
        links.append(part[4 + 8 * n :])
    return Frequent(order, len(order).to_bytes(4, "little") + b"".join(numbers) + b"".join(lengths) + b"".join(links))


def in_blocks(docs: DataFrame, path_a: str, path_b: str, frequent: Broadcast, block_segments: int, block_chars: int) -> DataFrame:
    """A row for each document, with its segments' numbers (null without a text) in order and once each, and one for each segment of a block's own.

    Blocks are made once and stored, so both later passes see the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = vocabularies(path_a, path_b), frequent.value
        block, numbers, size, listed = TaskContext.get().partitionId() << 32, Numbers(known), 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    rows.append((block, doc_id, None, None, None, None))
                    continue
                size += len(text)
                found = words.segments(text)
                at = np.fromiter(map(numbers.__getitem__, found), dtype=np.int64, count=len(found))
                once = np.unique(at)
                rows.append((block, doc_id, _packed(at), _packed(np.diff(once, prepend=0)), None, None))
                rows += [(block, None, None, None, len(known.segments) + k, numbers.new[k]) for k in range(listed, len(numbers.new))]
                listed = len(numbers.new)
                if listed >= block_segments or size >= block_chars:
                    block, numbers, size, listed = block + 1, Numbers(known), 0, 0
            yield _batch(rows, _CUT)

    return docs.mapInArrow(run, _ddl(_CUT))


def aligned(segments: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(block, key, body): packed alignments of each (block, number, segment), several of a block in one row.

    Equal segments meet in one task and are tokenized once. A task gathers what it has for a block
    before it hands it on; key is the first number of a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies(path_a, path_b)
        last: str | None = None
        body, n = b"", 0
        gathered: dict[int, tuple[list[int], list[bytes]]] = {}

        def handed() -> pa.RecordBatch:
            return _batch([(block, numbers[0], Aligned.packed(numbers, bodies)) for block, (numbers, bodies) in gathered.items()], _ALIGNED)

        for batch in batches:
            texts = batch.column("segment").to_pylist()
            new = [s for s, before in zip(texts, [last, *texts], strict=False) if s != before]
            made = chain.from_iterable(words.align(new[at : at + BATCH]) for at in range(0, len(new), BATCH))
            for block, number, s in zip(batch.column("block").to_pylist(), batch.column("number").to_pylist(), texts, strict=True):
                if s != last:
                    body, last = next(made), s
                numbers, bodies = gathered.setdefault(block, ([], []))
                numbers.append(number)
                bodies.append(body)
            n += len(texts)
            if n >= GATHERED:
                yield handed()
                gathered, n = {}, 0
        yield handed()

    met = segments.select("block", "number", "segment").repartition("segment").sortWithinPartitions("segment")
    return met.mapInArrow(run, _ddl(_ALIGNED))


def _by_block(*parts: DataFrame) -> DataFrame:
    """Rows (block, kind, key, body) of one block beside each other, kinds in turn, by key."""
    every = [p.select("block", F.lit(k).cast("byte").alias("kind"), "key", "body") for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, every).repartition("block").sortWithinPartitions("block", "kind", "key")


def _blocks(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[tuple[int, list[list[tuple]], Iterator[list[tuple]]]]:
    """Each block: its rows (key, body) of the kinds before `documents`, and its documents some at a time."""
    rows = ((b, k, key, body) for batch in batches for b, k, key, body in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "key", "body")), strict=True))
    for block, here in groupby(rows, key=itemgetter(0)):
        kinds: list[list[tuple]] = [[] for _ in range(documents)]
        first = None
        for row in here:
            if row[1] == documents:
                first = row
                break
            kinds[row[1]].append(row[2:])
        rest = chain([first] if first else [], here)
        yield block, kinds, iter(lambda: [r[2:] for r in islice(rest, COMPOSED)], [])  # noqa: B023


class HeldPairs:
    """The distinct pairs of each segment of a block, numbered from 0."""

    def __init__(self, frequent: Frequent, own: Aligned):
        known = frequent.aligned
        pairs = np.concatenate([known.pairs, own.pairs])
        self.pairs, ids = np.unique(pairs, return_inverse=True)
        segments = np.concatenate([known.of, own.of + len(known.lossless)])
        once = np.unique(segments * len(self.pairs) + ids)
        self.ids = once % max(1, len(self.pairs))
        self.lossless = np.concatenate([known.lossless, own.lossless])
        self.starts = np.searchsorted(once, np.arange(len(self.lossless) + 1) * len(self.pairs))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The distinct pairs of some segments together."""
        starts = self.starts[numbers]
        lengths = self.starts[numbers + 1] - starts
        ends = np.cumsum(lengths)
        return np.unique(self.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)])


def holding_counts(documents: DataFrame, alignments: DataFrame, frequent: Broadcast) -> DataFrame:
    """(block, pair, holding): how many documents of a block hold a linked id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (own,), documents in _blocks(batches, 1):
            held = HeldPairs(frequent.value, Aligned.unpacked([body for _, body in own]))
            counts = np.zeros(len(held.pairs), dtype=np.int64)
            for some in documents:
                for _, body in some:
                    numbers = np.cumsum(_unpacked(body))
                    if held.lossless[numbers].all():
                        counts[held.of(numbers)] += 1
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(held.pairs[at]), pa.array(counts[at])], schema=_COUNTED)

    whole = documents.filter("document IS NOT NULL").select("block", F.lit(0).cast("long").alias("key"), F.col("held").alias("body"))
    return _by_block(alignments, whole).mapInArrow(run, _ddl(_COUNTED))


def corpus_counts(held: DataFrame) -> DataFrame:
    """(pair, holding, best): documents of the corpus that hold a pair, and whether no pair of its first id is held by more."""
    counts = held.groupBy("pair").agg(F.sum("holding").alias("holding"))
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a")).agg(F.max("holding").alias("most"))
    return counts.withColumn("a", first).join(most, "a").select("pair", "holding", (F.col("holding") == F.col("most")).alias("best"))


def _counted(pairs: np.ndarray, known: np.ndarray, holding: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """holding and best of each pair; pairs that no document holds are not known and count 0."""
    if not len(known):
        return np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool)
    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    found = known[at] == pairs
    return np.where(found, holding[at], 0), best[at] & found


def composed(documents: DataFrame, alignments: DataFrame, known: DataFrame, frequent: Broadcast, sums: Broadcast) -> DataFrame:
    """The result row of each document with a text, from its block's counts and alignments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (counts, own), documents in _blocks(batches, 2):
            segments = Aligned.unpacked([body for _, body in own])
            numbers = np.array([struct.unpack(COUNT, body) for _, body in counts], dtype=np.int64).reshape(-1, 2)
            pairs = np.fromiter((pair for pair, _ in counts), dtype=np.int64, count=len(counts))
            holding, best = _counted(segments.pairs, pairs, numbers[:, 0], numbers[:, 1] > 0)
            table = np.concatenate([sums.value, segments.sums(holding, best)])
            groups = frequent.value.groups + segments.groups()
            for some in documents:
                rows = []
                for doc_id, body in some:
                    at = _unpacked(body)
                    total = table[at].sum(axis=0).tolist()
                    rows.append((doc_id, *[0] * len(_SUMS), "") if total[-1] else (doc_id, *total[:-1], ";".join(map(groups.__getitem__, at.tolist()))))
                yield _batch(rows, _COMPOSED)

    whole = documents.filter("document IS NOT NULL").select("block", F.col("doc_id").alias("key"), F.col("document").alias("body"))
    # holding and best as COUNT packs them
    packed = F.concat(F.unhex(F.lpad(F.hex("holding"), 16, "0")), F.unhex(F.when(F.col("best"), "01").otherwise("00")))
    counts = known.select("block", F.col("pair").alias("key"), packed.alias("body"))
    return _by_block(counts, alignments, whole).mapInArrow(run, _ddl(_COMPOSED))


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_segments: int = BLOCK_SEGMENTS, block_chars: int = BLOCK_CHARS, frequent: int = FREQUENT, sample: int = SAMPLE
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups for each row of docs.

    groups has the ids of both tokenizers (`a1,a2|b1;a3|b2,b3`), cut where tokens of both end at
    one byte. Links are the overlapping token pairs; the count of an id pair is the number of rows
    that hold it linked; n_best counts links with their first id's highest count, ties included.

    Null and empty texts, and those that the tokens of either vocabulary do not give back byte for
    byte, have zeros and empty groups, and hold no pair. Repeated rows and null ids count each as a
    document; an empty table gives an empty result; other columns are ignored. A text without
    white space is one segment. A task holds the different segments of one block, and the
    `frequent` ones.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    common = frequent_segments(texts, path_a, path_b, frequent, sample)
    shared = sc.broadcast(common)
    cut = stored(in_blocks(texts, path_a, path_b, shared, block_segments, block_chars), "token-blocks")
    documents = cut.filter("number IS NULL").select("block", "doc_id", "document", "held")
    alignments = stored(aligned(cut.filter("number IS NOT NULL"), path_a, path_b), "token-alignments")
    held = stored(holding_counts(documents, alignments, shared), "token-pairs")
    counts = cut_lineage(corpus_counts(held))
    known = held.select("block", "pair").join(counts, "pair")
    # the pairs of frequent segments are as bounded as these
    of_common = docs.sparkSession.createDataFrame(pa.table({"pair": np.unique(common.aligned.pairs)}))
    found = counts.join(F.broadcast(of_common), "pair").orderBy("pair").toArrow()
    numbers = [found.column(c).to_numpy() for c in ("pair", "holding", "best")]
    sums = sc.broadcast(common.aligned.sums(*_counted(common.aligned.pairs, *numbers)))
    empty = documents.filter("document IS NULL").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in _SUMS], F.lit("").alias("groups"))
    return composed(documents, alignments, known, shared, sums).unionByName(empty)


def digests(rows: DataFrame) -> DataFrame:
    """The groups as a digest; without tokens the column is ''."""
    return rows.select("doc_id", *_SUMS, F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"))
