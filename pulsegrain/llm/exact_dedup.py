"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. The different contents of all blocks are
dealt over tasks and sorted there; a content's integer name is its task and its place in the sorted
order. Then adjacent pairs of names are named in the same way, level after level, until one name is
left for each document. A name stands for one content only, so equal names are equal texts.

Rows find their name by a 64-bit hash of the content, which travels in its place. Hashes that two
contents share, which is looked up over all names, lead by the content itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut_lineage, stored, whole_rows

#: Bytes of a block. Longer blocks need fewer levels, shorter ones smaller rows to sort.
BLOCK_BYTES = 16384
#: Repeats of one row that are made from one array.
REPEATS_STEP = 10_000


def _named(rows: DataFrame, *content: str) -> DataFrame:
    """rows with the integer `name` in place of the content columns."""
    rows = rows.withColumn("hash", F.xxhash64(*content))
    known = rows.select("hash", *content).distinct()
    # (task, place in it) as one number; written, so that it stays when a task is run again
    names = stored(known.sortWithinPartitions(*content).select("hash", F.monotonically_increasing_id().alias("name")), "names")
    others = [c for c in rows.columns if c not in ("hash", *content)]
    shared = cut_lineage(names.groupBy("hash").count().filter("count > 1").select("hash"))
    if shared.isEmpty():
        return rows.select(*others, "hash").join(names, "hash").select(*others, "name")
    # the contents of one hash take its names in order
    place = lambda *by: F.row_number().over(Window.partitionBy("hash").orderBy(*by))
    free = names.join(shared, "hash").withColumn("nth", place("name"))
    told = known.join(shared, "hash").withColumn("nth", place(*content)).join(free, ["hash", "nth"]).drop("nth")
    told = rows.join(shared, "hash", "left_semi").join(told, ["hash", *content]).select(*others, "name")
    return rows.join(shared, "hash", "left_anti").select(*others, "hash").join(names, "hash").select(*others, "name").unionByName(told)


def name_documents(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct (id, text): id, sha, n_blocks, name, times.

    Two rows have the same (n_blocks, name) exactly when their texts are equal after each run of
    ASCII white space became one space. `times` counts repeated rows. Null text is ''.
    """
    if block_bytes < 1:
        raise ValueError("block_bytes must be at least 1")
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), ASCII_SPACE, " ")
    base = docs.select(F.col(id_col).cast("long").alias("id"), norm.cast("binary").alias("bytes"))
    n = F.greatest(F.lit(1), F.ceil(F.length("bytes") / F.lit(block_bytes)).cast("int"))
    base = base.select("id", F.sha2("bytes", 256).alias("sha"), n.alias("n_blocks"), "bytes")
    pieces = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = base.select("id", "sha", "n_blocks", F.posexplode(pieces).alias("pos", "block"))
    level = _named(blocks, "block").select("id", "sha", "n_blocks", "pos", "name")
    # repeated rows collapse here, once their number is known
    level = cut_lineage(level.groupBy("id", "sha", "n_blocks", "pos", "name").agg(F.count("*").alias("times")))

    done = level.filter("n_blocks = 1").select("id", "sha", "n_blocks", "name", "times")
    width = level.agg(F.max("n_blocks")).first()[0] or 1
    level = level.filter("n_blocks > 1").withColumn("left", F.col("n_blocks"))
    nobody = F.lit(-1).cast("long")  # beside the last name of an odd number
    while width > 1:
        width = (width + 1) // 2
        first, second = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = level.groupBy("id", "sha", "n_blocks", "left", "times", F.floor(F.col("pos") / 2).alias("pos")).agg(F.max(first).alias("a"), F.coalesce(F.max(second), nobody).alias("b"))
        pairs = pairs.withColumn("left", F.ceil(F.col("left") / 2).cast("int"))
        level = cut_lineage(_named(pairs, "a", "b").select("id", "sha", "n_blocks", "left", "times", "pos", "name"))
        done = done.unionByName(level.filter("left = 1").select("id", "sha", "n_blocks", "name", "times"))
        level = level.filter("left > 1")
    return done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, repeats_step: int = REPEATS_STEP) -> DataFrame:
    """Which row of each group of equal texts stays.

    Returns one row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. The smallest
    id of a group stays; null ids come last, so a group of null ids only has a null keep_id and
    one of them stays. Of repeated rows (same id, same text) one is kept. Null and empty texts
    are equal to each other. An empty table gives an empty result; other columns are ignored.
    """
    named = name_documents(docs, id_col, text_col, block_bytes)
    # read back from disk, both sides of the join are plain shuffles, whose hot keys Spark splits
    groups = cut_lineage(named.groupBy("n_blocks", "name").agg(F.min("id").alias("keep_id"), F.sum("times").alias("group_size")))
    out = named.join(groups, ["n_blocks", "name"])
    # repeated rows come back in two steps, so that no array grows with their number
    step = F.lit(repeats_step).cast("long")
    out = out.select("id", "sha", "keep_id", "group_size", "times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"), step)).alias("from"))
    out = out.select("id", "sha", "keep_id", "group_size", F.explode(F.sequence(F.col("from"), F.least(F.col("times"), F.col("from") + step - 1))).alias("nth"))
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text an earlier id has; one of several repeated rows stays.

    All columns of docs come back. Repeated ids with different texts are told apart by the text.
    """
    named = name_documents(docs, id_col, text_col, block_bytes)
    groups = cut_lineage(named.groupBy("n_blocks", "name").agg(F.min("id").alias("keep_id")))
    kept = named.join(groups, ["n_blocks", "name"]).filter(F.col("id").eqNullSafe(F.col("keep_id")))
    kept = kept.select(F.col("id").alias("__id"), F.col("sha").alias("__sha"))
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), ASCII_SPACE, " ")
    keyed = whole_rows(docs, __id=F.col(id_col).cast("long"), __sha=F.sha2(norm.cast("binary"), 256))
    same = keyed["__id"].eqNullSafe(kept["__id"]) & (keyed["__sha"] == kept["__sha"])
    stays = keyed.join(kept, same, "left_semi")
    if not named.filter("times > 1").isEmpty():
        stays = stays.dropDuplicates(["__id", "__sha"])
    return stays.select("__row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
