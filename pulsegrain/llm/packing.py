"""Vector bin packing of tokenized documents or instruction examples into fixed-size sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. Each bin is filled
by the dot-product rule: of the waiting examples that fit, the one whose demand has the largest
dot product with what the bin has left comes next. Where examples may be cut, a gap that nothing
fits is filled with the head of an example. Each Spark partition packs its own rows with a bounded
pool, so nothing is shuffled, and a lost task redoes its own sequences only.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .word_cache import WordCache

TOKENS, SEGMENTS = 2048, 128
CLOSING_ID = 1
#: Marks that the tokenizer parts from letters before them and keeps together.
MARKS = ".,;:!?%*#&$|)"
#: Examples that wait in a task at once, and the sequences they would fill.
POOL, WAITING = 4096, 64

#: Byte-level vocabularies write the bytes that are no visible characters as letters from U+0100 on.
BYTE_LETTERS = {b: 0x100 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, the same as the tokenizer's own.

    This tokenizer drops white space and never joins what it separates, so the ids of a text are
    those of its words, and words are remembered. A text with unusual white space goes to the
    tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        plain = json.loads(self.full.to_str())
        plain["normalizer"] = None
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.model = self.plain.model
        self.words = WordCache(self._word, size=600_000)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if max(word) < "Ā":  # Latin-1 is composed already and has simple lower case
            word = word.lower()
            letters = word.rstrip(MARKS)
            if letters != word and letters.isalpha():  # two pieces that never merge
                return self.words[letters] + self.words[word[len(letters) :]]
            if word.isalpha():  # one piece, which the model takes as it is, each byte as a letter
                piece = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
                return self._bytes([t.id for t in self.model.tokenize(piece)])
            return self._bytes(self.plain.encode(word, add_special_tokens=False).ids)
        return self._bytes(self.full.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        words = text.split()
        if sum(map(len, words)) + sum(map(text.count, " \n\t\r")) != len(text):
            return self._bytes(self.full.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, words))


@dataclass(slots=True)
class Item:
    """What is left of an example: tokens from `start` on; those before `loss_from` bear no loss."""

    doc: int | None
    ids: bytes
    start: int
    loss_from: int

    @property
    def total(self) -> int:
        return len(self.ids) // 4

    @property
    def left(self) -> int:
        return self.total - self.start

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_from))

    def longest(self, tokens: int, loss: int) -> int:
        """The longest piece within so many tokens and loss-bearing tokens."""
        return min(self.left, tokens, max(0, self.loss_from - self.start) + loss)


class Packer:
    """Fills sequences from a pool of examples."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int, cut: bool):
        self.limits, self.cut, self.next_id = (tokens, segments, loss), cut, first_id
        self.pool: list[Item] = []
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple[Item, int]]) -> None:
        offset = 0
        for item, length in pieces:
            crc = zlib.crc32(memoryview(item.ids)[4 * item.start : 4 * (item.start + length)])
            self.rows.append((item.doc, item.start, length, crc, item.total, self.next_id, offset, item.loss(length)))
            offset += length
        self.next_id += 1

    def add(self, item: Item) -> None:
        tokens, _, loss = self.limits
        if not self.cut and (item.left > tokens or item.loss(item.left) > loss):
            raise ValueError(f"an example of {item.left} tokens is over the limits and may not be cut")
        while self.cut and item.left >= tokens and item.longest(tokens, loss) == tokens:
            self.emit([(item, tokens)])
            item = Item(item.doc, item.ids, item.start + tokens, item.loss_from)
        if item.left:
            self.pool.append(item)

    def fill(self, capacity: int, need: np.ndarray) -> int:
        """One sequence of up to `capacity` tokens; its number of tokens.

        need has a row of tokens, segments and loss for each example of the pool; an example that
        is used up has no tokens there.
        """
        _, segments, loss = self.limits
        pool, pieces, room = self.pool, [], [capacity, segments, loss]
        scale = np.array([1 / capacity, 1 / segments, 1 / max(1, loss)]) ** 2
        taken: set[int] = set()
        while room[0] and room[1]:
            waits = need[:, 0] > 0
            if taken:
                waits[list(taken)] = False
            fits = waits & (need[:, 0] <= room[0]) & (need[:, 2] <= room[2])
            if self.cut and room[1] == 1:
                fits &= need[:, 0] == room[0]  # the last segment has to fill the sequence
            value = need @ (scale * room)
            k = int(np.argmax(np.where(fits, value, -1)))
            if fits[k]:
                length = pool[k].left
            elif self.cut:
                k = int(np.argmax(np.where(waits, value, -1)))
                length = pool[k].longest(room[0], room[2]) if waits[k] else 0
            else:
                length = 0
            if not length:
                break
            item = pool[k]
            taken.add(k)
            pieces.append((k, item, length))
            room = [room[0] - length, room[1] - 1, room[2] - item.loss(length)]
            self.keep(k, item, length, need)
            if length < item.left:
                break
        used = capacity - room[0]
        if self.cut and used & (used - 1) and used != capacity:
            # stopped by another limit: keep a power of two, which needs no padding
            over = used - (1 << (used.bit_length() - 1))
            used -= over
            while over:
                k, item, length = pieces.pop()
                back = min(over, length)
                over -= back
                if length > back:
                    pieces.append((k, item, length - back))
                self.keep(k, item, length - back, need)
        self.emit([x[1:] for x in pieces])
        return used

    def keep(self, k: int, item: Item, length: int, need: np.ndarray) -> None:
        """Leaves in the pool what is behind the first `length` tokens of an example."""
        rest = Item(item.doc, item.ids, item.start + length, item.loss_from)
        self.pool[k] = rest
        need[k] = (rest.left, 1, rest.loss(rest.left))

    def flush(self, last: bool) -> None:
        """Makes full sequences while there is choice; at the end, what is left in powers of two."""
        capacity = self.limits[0]
        need = np.array([[i.left, 1, i.loss(i.left)] for i in self.pool], dtype=float).reshape(-1, 3)
        total = int(need[:, 0].sum())
        while total and (last or total > WAITING * capacity or len(self.pool) > POOL):
            if total < capacity and self.cut:
                total -= self.fill(1 << (total.bit_length() - 1), need)
            else:
                total -= self.fill(capacity, need)
            if not last and len(self.pool) > POOL:
                self.pool = [i for i in self.pool if i.left]
                need = need[need[:, 0] > 0]
        self.pool = [i for i in self.pool if i.left]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokens: int = TOKENS,
    segments: int = SEGMENTS,
    loss: int | None = None,
    cut: bool = True,
) -> DataFrame:
    """Packs every row into sequences; one row per piece (see PIECES).

    A row's tokens are those of its prompt (none bears loss), of its text, and a closing id. Null
    texts and prompts are empty, so every row has at least the closing id. Rows with null or equal
    ids are packed each on its own. With cut=False examples stay whole, and one over a limit is an
    error. An empty table gives an empty result; other columns are ignored.
    """
    limits = (tokens, segments, tokens if loss is None else loss)
    if min(limits) < 1:
        raise ValueError("limits must be at least 1")
    prompt = F.col(prompt_col) if prompt_col else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _TOKENIZER  # a worker that is used again keeps its words
        if _TOKENIZER is None or _TOKENIZER[0] != tokenizer_path:
            _TOKENIZER = (tokenizer_path, WordTokenizer(tokenizer_path))
        encode = _TOKENIZER[1]
        packer = Packer(TaskContext.get().partitionId() << 36, *limits, cut)
        closing = WordTokenizer._bytes([CLOSING_ID])
        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

        def out() -> pa.RecordBatch:
            columns = zip(*packer.rows, strict=True) if packer.rows else [[]] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], schema=schema)
            packer.rows = []
            return batch

        for batch, texts in text_batches(batches, "text"):
            prompts = [p or "" for p in batch.column("prompt").to_pylist()]
            for doc, text, before in zip(batch.column("id").to_pylist(), texts, prompts, strict=True):
                head = encode(before) if before else b""
                packer.add(Item(doc, head + encode(text) + closing, 0, len(head) // 4))
            packer.flush(last=False)
            yield out()
        packer.flush(last=True)
        yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), prompt.alias("prompt"))
    return rows.mapInArrow(run, PIECES)


def pack_conversations(conversations: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", answers: str = "assistant", tokens: int = TOKENS, segments: int = 16, loss: int = 1024) -> DataFrame:
    """Packs each answer of a conversation with the turn before it as prompt; one row per piece, doc_id is the conversation.

    Tokens, segments and loss-bearing tokens, which are those of answers, are limited at once. An
    answer without a turn before it has an empty prompt; turns of other roles only serve as
    prompts; null texts are empty. Of turns with one number the one with the smallest text is the
    prompt, and answers come back each on its own. Conversations with a null id have no prompts.
    """
    rows = conversations.select(F.col(conv_col).cast("long").alias("doc_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # a join on (conversation, turn), so that a long conversation is no single group
    before = rows.groupBy("doc_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    asked = rows.filter(F.col("role") == answers).join(before, ["doc_id", "turn"], "left")
    return pack(asked, tokenizer_path, "doc_id", "text", "prompt", tokens, segments, loss)


_TOKENIZER: tuple[str, WordTokenizer] | None = None
