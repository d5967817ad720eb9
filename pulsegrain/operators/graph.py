"""Object graphs: breadth-first parents, retained sizes, censuses and root paths; dominators are in dominators.py.

nodes has (node, type, size); edges has (src, dst, ordinal). Rounds write their small result to the
checkpoint folder, so lost executors only redo the last one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@cache
def _local_folder() -> str:
    """One folder for a local process, which goes with it."""
    made = tempfile.mkdtemp(prefix="pulsegrain-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only a local session, as in tests, may leave it unset and has one made: executors on other
    machines would not see that.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _local_folder()


def kept(df: DataFrame) -> DataFrame:
    """Writes df as Parquet below the shared checkpoint folder and reads it from there.

    What is read back has neither the plan nor the partitions of the rounds before it.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def breadth_first(edges: DataFrame, root) -> DataFrame:
    """(node, parent, depth, trail) of what the root reaches; the first discoverer is the parent.

    trail lists the edge ordinals from the root, which orders a level as a queue would.
    """
    kind = edges.schema["src"].dataType
    edges = kept(edges.select("src", "dst", "ordinal"))
    seen = edges.sparkSession.range(1).select(F.lit(root).cast(kind).alias("node"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("trail"))
    frontier, depth, levels = seen, 0, [seen]
    while True:
        depth += 1
        met = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.concat("trail", F.array("ordinal")).alias("trail"))
        first = met.groupBy("node").agg(F.min(F.struct("trail", "parent")).alias("m")).select("node", "m.parent", F.lit(depth).alias("depth"), "m.trail")
        frontier = kept(first.join(seen.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        # levels are stored already; only many of them are written again as one
        levels = [*levels, frontier] if len(levels) < 16 else [kept(seen.unionByName(frontier))]
        seen = reduce(DataFrame.unionByName, levels)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.transform(a, lambda _, i: i), lambda i: (i < n) & (F.get(a, i) != F.get(b, i)))
    return F.slice(a, F.lit(1), F.coalesce(F.get(differs, 0), n))


def retained_sizes(nodes: DataFrame, dominated: DataFrame) -> DataFrame:
    """(node, retained): a node keeps alive itself and all that it dominates, from rows (node, dominator)."""
    from .dominators import sums_below

    own = nodes.select("node", F.col("size").alias("value"), F.lit(True).alias("__known"))
    forest = kept(dominated.select("node", F.col("dominator").alias("parent")).join(own, "node", "left"))
    sums = sums_below(forest)
    # a node without a row of its own comes back only if it keeps others alive
    bare = forest.filter("__known IS NULL").select("node")
    if not bare.isEmpty():
        sums = sums.join(bare.withColumn("__bare", F.lit(True)), "node", "left").filter("__bare IS NULL OR value IS NOT NULL")
    return sums.select("node", F.col("value").alias("retained"))


def census(nodes: DataFrame, dominated: DataFrame) -> DataFrame:
    """Per type: count, exclusive bytes, retained bytes without same-type nesting, unreachable."""
    retained = retained_sizes(nodes, dominated)
    types = nodes.select(F.col("node").alias("dominator"), F.col("type").alias("dominator_type"))
    every = nodes.join(retained, "node", "left").join(dominated, "node", "left").join(types, "dominator", "left")
    top = F.col("dominator_type").isNull() | (F.col("dominator_type") != F.col("type"))
    return every.groupBy("type").agg(
        F.count("*").alias("n"), F.sum("size").alias("exclusive"), F.sum(F.when(top, F.coalesce("retained", F.lit(0))).otherwise(0)).alias("retained"), F.max("retained").alias("max_retained"), F.count_if(F.col("retained").isNull()).alias("unreachable")
    )


def type_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """References between types: count, and bytes of the objects pointed at."""
    to = nodes.select(F.col("node").alias("dst"), F.col("type").alias("to_type"), "size")
    src = nodes.select(F.col("node").alias("src"), F.col("type").alias("from_type"))
    # counts are made on the target's side first
    half = edges.join(to, "dst").groupBy("src", "to_type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return half.join(src, "src").groupBy("from_type", "to_type").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def capped_edges(edges: DataFrame, cap: int = 64) -> DataFrame:
    """References between types that are among the `cap` heaviest of their source or of their target, with both ranks."""
    out = Window.partitionBy("from_type").orderBy(F.desc("bytes"), F.desc("n"), "to_type")
    back = Window.partitionBy("to_type").orderBy(F.desc("bytes"), F.desc("n"), "from_type")
    ranked = edges.withColumns({"out_rank": F.row_number().over(out), "in_rank": F.row_number().over(back)})
    return ranked.filter((F.col("out_rank") <= cap) | (F.col("in_rank") <= cap))


def root_paths(nodes: DataFrame, parents: DataFrame, types: DataFrame | None = None, instances: int | None = None, deepest: int | None = None, most: int | None = None) -> DataFrame:
    """(slot, parent_slot, type, depth, n, bytes): a tree of the types on the ways from objects up to the root.

    A slot of depth 0 is a type, its children are the types of the parents of its objects, and so
    on. All reachable objects of each type (of `types`, if given) walk up together: those in one slot
    at one object become one row before each step. A viewer's budget can be given: the first
    `instances` objects of a type, `deepest` steps, and `most` slots in all, of which those of a
    level with most objects are made first and walks end there. parents has (node, parent), the
    root's parent is null; the root itself starts no walk.
    """
    typed = kept(parents.join(nodes, "node").select("node", "parent", "type", "size"))
    starts = typed.filter("parent IS NOT NULL")
    starts = starts if types is None else starts.join(types, "type", "left_semi")
    if instances is not None:
        starts = starts.withColumn("nth", F.row_number().over(Window.partitionBy("type").orderBy("node"))).filter(F.col("nth") <= instances)
    above = typed.select("node", F.col("parent").alias("next"), F.col("type").alias("next_type"))
    walks = kept(starts.select(F.lit(-1).cast("long").alias("slot"), F.col("type").alias("next_type"), "node", F.lit(1).cast("long").alias("n"), F.col("size").alias("bytes")))
    made, used, depth = None, 0, 0
    while True:
        children = walks.groupBy("slot", "next_type").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        if most is None:
            numbered = kept(children.withColumn("new", F.monotonically_increasing_id() + F.lit(used)))
            used = (numbered.agg(F.max("new")).first()[0] or 0) + 1
            on = numbered
        else:
            ranked = children.orderBy(F.desc("n"), F.desc("bytes"), "slot", "next_type").limit(most - used)
            # at most `most` rows are left, which are numbered in one task
            numbered = kept(ranked.withColumn("new", (F.row_number().over(Window.orderBy(F.desc("n"), F.desc("bytes"), "slot", "next_type")) + F.lit(used - 1)).cast("long")))
            used += numbered.count()
            on = F.broadcast(numbered)
        found = numbered.select(F.col("new").alias("slot"), F.col("slot").alias("parent_slot"), F.col("next_type").alias("type"), F.lit(depth).alias("depth"), "n", "bytes")
        made = found if made is None else made.unionByName(found)
        here = walks.join(on.select("slot", "next_type", F.col("new").alias("child")), ["slot", "next_type"]).groupBy("child", "node").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        step = here.join(above, "node").filter("next IS NOT NULL").select(F.col("child").alias("slot"), F.col("next").alias("node"), "n", "bytes")
        walks = kept(step.join(above.select("node", "next_type"), "node").select("slot", "next_type", "node", "n", "bytes"))
        if depth == deepest or (most is not None and used >= most) or walks.isEmpty():
            return made
        depth += 1


def path_names(tree: DataFrame) -> DataFrame:
    """The slots of root_paths with `path`, their types from the object up, joined level by level."""
    level = tree.filter("depth = 0").withColumn("path", F.col("type"))
    done, rest = level, tree
    for depth in range(1, (tree.agg(F.max("depth")).first()[0] or 0) + 1):
        up = level.select(F.col("slot").alias("parent_slot"), F.col("path").alias("before"))
        level = kept(rest.filter(F.col("depth") == depth).join(up, "parent_slot").withColumn("path", F.concat_ws("<", "before", "type")).select(*done.columns))
        done = done.unionByName(level)
    return done
