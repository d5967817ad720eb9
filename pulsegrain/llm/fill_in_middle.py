"""Fill-in-the-middle examples, cut between units of a text.

A text is stored as its maximal runs of one character class, each with the number of units that
have ended up to its end. A cut after k units is in the first run with k unit ends: binary search
finds it, and the place within follows from the count, without a list of the units.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: What ends a unit: each character of the first class, or a run of it as a whole. Other characters
#: end none, but for the last run of a text.
UNITS = {
    "line": (re.compile(r"\n+|[^\n]+"), "\n".__eq__, True),
    "word": (re.compile(r"\s+|\S+"), str.isspace, False),
    "character": (re.compile(r".+", re.S), lambda _: True, True),
}


class ClassRuns:
    """The runs of a text: where each begins, and the units that have ended up to its end."""

    __slots__ = ("text", "starts", "ends", "each")

    def __init__(self, text: str, unit: str = "line"):
        pattern, closes, self.each = UNITS[unit]
        self.text, self.starts, self.ends = text, [], []
        units = 0
        for run in pattern.finditer(text):
            begin, stop = run.span()
            if closes(text[begin]):
                units += stop - begin if self.each else 1
            elif stop == len(text):
                units += 1
            self.starts.append(begin)
            self.ends.append(units)

    @property
    def units(self) -> int:
        return self.ends[-1] if self.ends else 0

    def offset(self, k: int) -> int:
        """The place after the first k units."""
        if k <= 0:
            return 0
        at = bisect_left(self.ends, k)
        stop = self.starts[at + 1] if at + 1 < len(self.starts) else len(self.text)
        before = self.ends[at - 1] if at else 0
        # in a run where each character ends a unit, k is so many characters inside; else the run ends it
        return self.starts[at] + k - before if self.each and self.ends[at] - before == stop - self.starts[at] else stop


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers under 2**32 from the seed and the id; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(text: str, numbers: list[int], unit: str, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and the example."""
    runs = ClassRuns(text, unit)
    n = runs.units
    h1, h2, h3, h4 = numbers
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((runs.offset(h1 % (n + 1)), runs.offset(h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm_percent:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for each row of docs, from its whole text.

    n is the number of units (lines, words or characters). The numbers that choose cuts and form
    come from the seed and the id, so rows of one id with equal texts have equal results. Null
    and empty texts, texts with a mark in them, and those beyond `percent` stay plain. Rows with
    null or equal ids each come back; an empty table gives an empty result; other columns are
    ignored. A text without any unit end, however long, is one run.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            made = [transform(t, draws(i, seed), unit, percent, spm_percent) for i, t in zip(ids, texts, strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else [()] * 5
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of: its parts stand between the marks, in the form's order."""

    def between(first: str, second: str) -> Column:
        return F.substring_index(F.substring_index(output, second, 1), first, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(examples: DataFrame) -> DataFrame:
    """Digests of the example and of the text that is rebuilt from it."""
    hashed = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return examples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


SQL = r"""WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, lines, CAST(len(lines) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(lines[1:low], '') AS p, array_to_string(lines[low + 1:high], '') AS m, array_to_string(lines[high + 1:n], '') AS s FROM formed
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM made"""
