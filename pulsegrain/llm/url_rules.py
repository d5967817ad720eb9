"""Host and path rules on URLs by a sort-merge range join.

The canonical key of a host is its labels in reverse order, each with a dot behind it, so that
`m.example.net` is `net.example.m.`. A rule's host and all its subdomains are then the keys with a
common prefix, an interval `[net.example., net.example/)`, and two such intervals are nested or
apart. Pages and rules are range-partitioned and sorted by key. A sweep over a partition keeps the
stack of the intervals that are open at the current key, each with its paths; a prefix among sorted
paths is found by binary search and by the links from a path to the one it is nested in.

A partition also needs the intervals that were opened before its first key. Those are the rules of
the hosts above that key, an equality join of a few rows for each partition.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: What a page gets that no rule fits.
DEFAULT = "allow"
#: (verdict, host, path) of the query op11.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: from the first :// to /, ?, # or the end, then to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical_key(host: Column) -> Column:
    """Labels in reverse order, each with a dot behind it; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


class Open:
    """An interval of the sweep: where it ends, and the sorted paths of its host."""

    __slots__ = ("key", "end", "host", "paths", "verdicts", "outer")

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.end = key[:-1] + "/"  # the character after the dot
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.outer: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        """Paths come in order; a path links to the longest earlier one that is a prefix of it."""
        if self.paths and self.paths[-1] == path:
            return  # both carried in and met again
        up = len(self.paths) - 1
        while up >= 0 and not path.startswith(self.paths[up]):
            up = self.outer[up]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.outer.append(up)

    def longest(self, path: str) -> int:
        """The place of the longest path that is a prefix of the given one, or -1."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


class Sweep:
    """Takes keys in order and keeps the intervals that are open there."""

    def __init__(self) -> None:
        self.stack: list[Open] = []
        self.last: tuple[str, str] | None = None
        self.found: tuple[str | None, str | None] = (None, None)

    def _to(self, key: str) -> None:
        while self.stack and self.stack[-1].key and key >= self.stack[-1].end:
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self._to(key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(Open(key, host))
        self.stack[-1].add(path, verdict)
        self.last = None

    def page(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, of two equally long ones that with the longer host, and its verdict."""
        if self.last != (key, path):
            self._to(key)
            best, self.found = (-1, -1), (None, None)
            for level in self.stack:
                at = level.longest(path)
                size = (len(level.host) + len(level.paths[at]), len(level.host))
                if at >= 0 and size > best:
                    best, self.found = size, (level.host + level.paths[at], level.verdicts[at])
            self.last = (key, path)
        return self.found


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null) and verdict for each row of pages.

    A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with
    the rule's. The longest counts, by host and path together, of equally long ones that with the
    longer host. Of two rules with equal host and path the one that blocks counts. A rule without
    a host fits all hosts. A page that no rule fits has `default`.

    Null URLs and those without :// have an empty host and path. Repeated rows and null ids each
    come back; pages of one URL are dealt over many tasks by their ids; an empty table of pages
    gives an empty result, one of rules leaves `default`; other columns are ignored. A task holds
    the rules of the hosts above its current key.
    """
    host, path = url_parts(F.col(url_col))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    page = page.select("page_id", "host", "path", canonical_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.xxhash64("page_id", "host", "path").alias("salt"), F.lit(None).cast("string").alias("verdict"))
    one = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = one.select(F.lit(None).cast("long").alias("page_id"), "host", "path", canonical_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), "verdict")
    order = ["key", "kind", "path", "salt"]
    parts = stored(page.unionByName(rule).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "url-ranges")

    first = parts.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split("first", r"\.")
    hosts = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.when(i > 0, F.lit(".")).otherwise(F.lit(""))))
    above = first.select("part", F.explode(hosts).alias("key"))
    opened = above.distinct().join(rule.drop("part"), "key").select(*parts.columns)
    swept = parts.unionByName(opened).repartition("part").sortWithinPartitions("part", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sweep = None, Sweep()
        for batch in batches:
            ids, found = [], []
            for new, page_id, host, path, key, kind, verdict in zip(*(batch.column(c).to_pylist() for c in ("part", "page_id", "host", "path", "key", "kind", "verdict")), strict=True):
                if new != part:
                    part, sweep = new, Sweep()
                if kind == 0:
                    sweep.rule(key, host, path, verdict)
                else:
                    text, says = sweep.page(key, path)
                    ids.append(page_id)
                    found.append((host, path, text, says or default))
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])

    return swept.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def rules_sql(rules: Iterable[tuple[str, str, str]], default: str = DEFAULT) -> str:
    """The SQL of the query, with its rules written out."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS nth, page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict, row_number() OVER (PARTITION BY nth ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS place
  FROM parts p LEFT JOIN (VALUES {values}) r(verdict, rule_host, rule_path) ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM fits WHERE place = 1"""


SQL = rules_sql(RULES)
