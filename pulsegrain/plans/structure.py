"""Queries over stacks, address ranges, heap graphs and snapshots built from the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dominators as dominator_tree
from ..operators import graph, heap, rank, stacks, symbols, temporal
from ..sources import tables
from .registry import STACKS, query

NODES = "nd AS (SELECT frames[1:d] AS f, d AS depth, array_to_string(frames[1:d], '|') AS path, frames[d] AS frame, sum(weight) AS weight, count(*) AS stacks FROM st, range(1, 5) r(d) GROUP BY ALL)"
FLAME = "fl AS (SELECT list_reverse(frames) AS frames, weight FROM st), nd AS (SELECT frames[1:d] AS f, d AS depth, array_to_string(frames[1:d], '|') AS path, frames[d] AS frame, sum(weight) AS weight, count(*) AS stacks FROM fl, range(1, 5) r(d) GROUP BY ALL)"
RANKED = "rk AS (SELECT *, row_number() OVER w AS sibling, coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nd WINDOW w AS (PARTITION BY array_to_string(f[1:depth - 1], '|'), depth ORDER BY weight DESC, frame))"
UP = "up AS (SELECT n.path, max(a.sibling) AS worst, sum(a.before) AS x, list(a.sibling ORDER BY a.depth) AS visits FROM (SELECT path, f, unnest(range(1, depth + 1)) AS d FROM rk) n JOIN rk a ON a.path = array_to_string(n.f[1:n.d], '|') GROUP BY 1)"


def _nodes(spark: SparkSession, sf_dir: str, flame: bool = False) -> DataFrame:
    sales = tables.stacks_of_sales(spark, sf_dir)
    if flame:
        sales = sales.withColumn("frames", F.reverse("frames"))
    return stacks.fold(sales, "frames", ["weight"])


def _path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", "|"))


@query("S6_distinct_stacks", "SELECT array_to_string(frames, '|') AS path, 1 AS nth FROM (SELECT DISTINCT [p_type, p_brand] AS frames FROM part)")
def distinct_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.read(spark, sf_dir, "part").select(F.array("p_type", "p_brand").alias("frames"))
    return stacks.distinct_stacks(events, "frames").select(F.array_join("frames", "|").alias("path"), "nth")


@query("T1_caller_tree", f"WITH {STACKS}, {NODES} SELECT path, CAST(depth AS INTEGER) AS depth, weight, stacks FROM nd")
def caller_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(_nodes(spark, sf_dir)).select("path", "depth", "weight", "stacks")


@query("T2_scoped_trees", f"WITH {STACKS}, sc AS (SELECT 'all' AS scope, * FROM st UNION ALL SELECT 'asia', * FROM st WHERE frames[4] = 'ASIA') SELECT scope, array_to_string(frames[1:d], '|') AS path, sum(weight) AS weight, count(*) AS stacks FROM sc, range(1, 5) r(d) GROUP BY ALL")
def scoped_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = tables.stacks_of_sales(spark, sf_dir)
    scopes = F.when(F.col("frames")[3] == "ASIA", F.array(F.lit("all"), F.lit("asia"))).otherwise(F.array(F.lit("all")))
    tree = stacks.fold(sales.withColumn("scope", F.explode(scopes)), "frames", ["weight"], ["scope"])
    return _path(tree).select("scope", "path", "weight", "stacks")


@query("T3_flame_tree", f"WITH {STACKS}, {FLAME} SELECT path, CAST(depth AS INTEGER) AS depth, weight, CASE WHEN depth = 4 THEN stacks ELSE 0 END AS ending_stacks FROM nd")
def flame_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _path(_nodes(spark, sf_dir, flame=True))
    return nodes.select("path", "depth", "weight", F.when(F.col("depth") == 4, F.col("stacks")).otherwise(F.lit(0)).alias("ending_stacks"))


@query("T4_leaf_trees", f"WITH {STACKS} SELECT frames[1] AS leaf, array_to_string(frames[2:d], '|') AS path, sum(weight) AS weight FROM st, range(2, 5) r(d) WHERE frames[1] LIKE 'PROMO%' GROUP BY ALL")
def leaf_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = tables.stacks_of_sales(spark, sf_dir).withColumns({"leaf": F.col("frames")[0], "callers": F.slice("frames", 2, 100)}).filter(F.col("leaf").startswith("PROMO"))
    return _path(stacks.fold(hot, "callers", ["weight"], ["leaf"])).select("leaf", "path", "weight")


@query("T5_site_trees", f"WITH {STACKS}, s AS (SELECT 'wait' AS tree, frames[2:4] AS f, weight FROM st WHERE frames[1] LIKE 'SMALL%' UNION ALL SELECT 'exception', frames[1:4], ticks FROM st WHERE frames[1] LIKE 'LARGE%'), g AS (SELECT tree, f, sum(weight) AS weight FROM s GROUP BY ALL) SELECT tree, f[1] AS site, array_to_string(f[2:d], '|') AS path, sum(weight) AS weight, count(*) AS stacks FROM g, range(2, 5) r(d) WHERE d <= len(f) GROUP BY ALL")
def site_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of waiting sites by time, and of thrown types by number."""
    sales = tables.stacks_of_sales(spark, sf_dir)
    leaf = F.col("frames")[0]
    waits = sales.filter(leaf.startswith("SMALL")).select(F.lit("wait").alias("tree"), F.slice("frames", 2, 3).alias("f"), "weight")
    thrown = sales.filter(leaf.startswith("LARGE")).select(F.lit("exception").alias("tree"), F.col("frames").alias("f"), F.col("ticks").cast("double").alias("weight"))
    sites = waits.unionByName(thrown).groupBy("tree", "f").agg(F.sum("weight").alias("weight"))
    sites = sites.select("tree", F.col("f")[0].alias("site"), F.slice("f", 2, 100).alias("callers"), "weight")
    return _path(stacks.fold(sites, "callers", ["weight"], ["tree", "site"])).select("tree", "site", "path", "weight", "stacks")


@query("T6_best_first_budget", f"WITH {STACKS}, {FLAME}, {RANKED}, {UP}, ok AS (SELECT rk.*, row_number() OVER (PARTITION BY depth = 1 ORDER BY weight DESC, depth, f) AS n FROM rk JOIN up USING (path) WHERE worst <= 4) SELECT path, CAST(depth AS INTEGER) AS depth, weight FROM ok WHERE depth = 1 OR n <= 60")
def best_first_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(stacks.best_first(_nodes(spark, sf_dir, flame=True), "weight", 4, 60)).select("path", "depth", "weight")


@query("T7_depth_first_budget", f"WITH {STACKS}, {FLAME}, {RANKED}, {UP} SELECT path, CAST(row_number() OVER (ORDER BY visits) AS INTEGER) AS visit FROM rk JOIN up USING (path) WHERE worst <= 3 ORDER BY visits LIMIT 80")
def depth_first_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(stacks.depth_first(_nodes(spark, sf_dir, flame=True), "weight", 3, 80)).select("path", "visit")


@query("T8_flame_layout", f"WITH {STACKS}, {FLAME}, {RANKED}, {UP} SELECT path, x, weight FROM rk JOIN up USING (path)")
def flame_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(stacks.flame_layout(_nodes(spark, sf_dir, flame=True), "weight")).select("path", "x", "weight")


@query("A12_self_total", f"WITH {STACKS}, e AS (SELECT frames[1] AS leaf, unnest(list_distinct(frames)) AS frame, weight FROM st) SELECT frame, sum(CASE WHEN frame = leaf THEN weight ELSE 0 END) AS self, sum(weight) AS total FROM e GROUP BY 1 ORDER BY self DESC, frame LIMIT 200")
def self_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top(stacks.self_and_total(tables.stacks_of_sales(spark, sf_dir), "frames", "weight"), [F.desc("self"), F.col("frame")], 200)


@query("A40_strided_modules", "SELECT p_brand AS module, count(*) * 4 AS frames FROM part WHERE p_partkey % 4 = 0 GROUP BY 1 ORDER BY frames DESC, module LIMIT 12")
def strided_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.read(spark, sf_dir, "part").filter("p_partkey % 4 = 0")
    return rank.top(part.groupBy(F.col("p_brand").alias("module")).agg((F.count("*") * 4).alias("frames")), [F.desc("frames"), F.col("module")], 12)


RANGES = "rg AS (SELECT p_partkey * 100 AS s, p_partkey * 100 + p_size * 4 AS e, p_retailprice AS ld, p_retailprice + p_size * 20 AS ul, concat('m', p_partkey) AS name FROM part), lk AS (SELECT DISTINCT l_partkey * 100 + CAST(l_quantity AS BIGINT) * 3 AS address, floor(l_extendedprice / 30) AS t FROM lineitem)"


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = tables.read(spark, sf_dir, "part")
    ranges = part.select((F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size") * 4).alias("end"), F.col("p_retailprice").alias("load"), (F.col("p_retailprice") + F.col("p_size") * 20).alias("unload"), F.concat(F.lit("m"), "p_partkey").alias("name"))
    line = tables.read(spark, sf_dir, "lineitem")
    lookups = line.select((F.col("l_partkey") * 100 + F.col("l_quantity").cast("bigint") * 3).alias("address"), F.floor(F.col("l_extendedprice") / 30).cast("double").alias("t"))
    return lookups, ranges


@query("J1_symbolize", f"WITH {RANGES}, m AS (SELECT address, t, name, row_number() OVER (PARTITION BY address, t ORDER BY (t >= ld AND t < ul) DESC, s DESC) AS n FROM lk JOIN rg ON address >= s AND address < e) SELECT lk.address, lk.t, coalesce(m.name, concat('<unresolved 0x', upper(to_hex(lk.address)), '>')) AS name FROM lk LEFT JOIN m ON m.address = lk.address AND m.t = lk.t AND m.n = 1")
def symbolize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.resolve(*_ranges(spark, sf_dir), rows=tables.read(spark, sf_dir, "lineitem").count())


@query("J2_load_intervals", """WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id AS seq, event_type = 'purchase' AS un FROM events WHERE event_type IN ('click', 'purchase')),
r AS (SELECT *, sum(CAST(un AS INTEGER)) OVER w AS u, sum(CAST(NOT un AS INTEGER)) OVER w AS l FROM e WINDOW w AS (PARTITION BY k ORDER BY seq)), c AS (SELECT *, u - greatest(0, max(u - l) OVER (PARTITION BY k ORDER BY seq)) AS counted FROM r),
b AS (SELECT *, coalesce(lag(counted) OVER (PARTITION BY k ORDER BY seq), 0) AS before FROM c) SELECT a.k, a.seq AS load, z.seq AS unload FROM b a LEFT JOIN b z ON a.k = z.k AND z.un AND z.counted > z.before AND z.counted = a.l WHERE NOT a.un""")
def load_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir).filter(F.col("kind").isin("click", "purchase")).withColumn("is_unload", F.col("kind") == "purchase")
    return symbols.load_intervals(ev.select("k", "seq", "is_unload"), "k", "seq", "is_unload")


@query("J3_native_lookup", f"WITH {RANGES} SELECT address, max(s) AS start FROM lk JOIN rg ON address >= s AND address < e GROUP BY 1")
def native_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookups, ranges = _ranges(spark, sf_dir)
    rows = tables.read(spark, sf_dir, "lineitem").count()
    met = temporal.range_join(tables.dealt(lookups.select("address"), rows, "address").distinct(), ranges.select("start", "end"), "address", "start", "end", rows=rows)
    return met.groupBy("address").agg(F.max("start").alias("start"))


@query("J4_modules_with_symbols", f"WITH {RANGES}, mp AS (SELECT s_suppkey * 2000 AS ms, s_suppkey * 2000 + 900 AS me, s_name FROM supplier) SELECT DISTINCT s_name FROM mp JOIN rg ON s >= ms AND s < me")
def modules_with_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ranges = _ranges(spark, sf_dir)
    mappings = tables.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2000).alias("start"), (F.col("s_suppkey") * 2000 + 900).alias("end"), "s_name")
    return temporal.range_join(ranges.select(F.col("start").alias("at")), mappings, "at", "start", "end").select("s_name").distinct()


@query("J5_adjacent_overlaps", f"WITH {RANGES} SELECT count(*) AS n FROM (SELECT s, lag(e) OVER (ORDER BY s) AS pe FROM rg) WHERE s < pe")
def adjacent_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ranges = _ranges(spark, sf_dir)
    # cells of the address space are ordered in parallel; a cell's last row goes to the next one that has rows
    wide = 1_000_000
    rows = ranges.select(F.floor(F.col("start") / wide).alias("cell"), "start", "end", F.lit(True).alias("own"))
    cells = rows.groupBy("cell").agg(F.max(F.struct("start", "end")).alias("x"))
    last = cells.select(F.lead("cell").over(Window.partitionBy().orderBy("cell")).alias("cell"), "x.*", F.lit(False).alias("own")).filter("cell IS NOT NULL")
    w = Window.partitionBy("cell").orderBy("start", "end")
    return rows.unionByName(last).withColumn("prior", F.lag("end").over(w)).agg(F.count_if(F.col("own") & (F.col("start") < F.col("prior"))).alias("n"))


@query("J13_undefined_targets", "SELECT coalesce(CAST(s_suppkey AS VARCHAR), 'UNDEFINED') AS node, count(*) AS n FROM lineitem LEFT JOIN supplier ON l_partkey = s_suppkey GROUP BY 1")
def undefined_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers as targets among supplier numbers; most of them are no node."""
    counts = tables.read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    known = tables.read(spark, sf_dir, "supplier").select("s_suppkey")
    node = F.coalesce(F.col("s_suppkey").cast("string"), F.lit("UNDEFINED"))
    return counts.join(known, counts.l_partkey == known.s_suppkey, "left").groupBy(node.alias("node")).agg(F.sum("n").alias("n"))


@query("S13_positional_edges", """WITH b AS (SELECT o_orderkey, count(l_orderkey) AS c FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), o AS (SELECT *, coalesce(sum(c) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM b),
e AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos, l_partkey FROM lineitem) SELECT o_orderkey, CAST(sum(l_partkey) AS BIGINT) AS targets, count(*) AS n FROM o JOIN e ON e.pos >= o.first AND e.pos < o.first + o.c GROUP BY 1""")
def positional_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import heap_bulk

    line = tables.read(spark, sf_dir, "lineitem")
    counts = line.groupBy("l_orderkey").agg(F.count("*").alias("edge_count"))
    nodes = tables.read(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    nodes = nodes.select(F.floor(F.col("o_orderkey") / 1000).alias("block"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("address"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
    edges = line.select(F.floor(F.col("l_orderkey") / 1000).alias("block"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("target"))
    met = heap_bulk.attach_edges(nodes, edges)
    return met.groupBy(F.col("address").alias("o_orderkey")).agg(F.sum("target").alias("targets"), F.count("*").alias("n"))


OBJECTS = "ob AS (SELECT l_suppkey AS segment, l_orderkey * 10 + l_linenumber AS address, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS size, min(l_linenumber % 3) AS generation, bool_and(l_returnflag = 'A') AS is_free, min(p_brand) AS type FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _objects(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Objects of the heap, dealt by (segment, address), or by the columns whose rows a query puts in order."""
    line, part = tables.read(spark, sf_dir, "lineitem"), tables.read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = line.count()
    sales = tables.dealt(line.select("l_partkey", F.col("l_suppkey").alias("segment"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("address"), "l_extendedprice", "l_linenumber", "l_returnflag"), rows, "l_partkey")
    objects = tables.dealt(sales.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey"), rows, *(by or ("segment", "address"))).groupBy("segment", "address")
    # an address is one object, though a generated line number may occur twice
    return objects.agg(F.sum(F.floor("l_extendedprice")).alias("size"), F.min(F.col("l_linenumber") % 3).alias("generation"), F.bool_and(F.col("l_returnflag") == "A").alias("is_free"), F.min("p_brand").alias("type"))


@query("J16_gap_neighbours", f"WITH {OBJECTS}, a AS (SELECT *, last_value(CASE WHEN NOT is_free THEN address END IGNORE NULLS) OVER (PARTITION BY segment ORDER BY address ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM ob), b AS (SELECT *, lead(address) OVER w AS na, lead(is_free) OVER w AS nf FROM a WHERE NOT is_free OR size >= 50000 WINDOW w AS (PARTITION BY segment ORDER BY address)) SELECT segment, address, size, previous, CASE WHEN NOT nf THEN na END AS following FROM b WHERE is_free")
def gap_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.gap_neighbours(_objects(spark, sf_dir, "segment"), 50_000)


@query("J17_pinned_objects", f"WITH {OBJECTS} SELECT segment, address, address IN (SELECT o_orderkey * 10 + 1 FROM orders WHERE o_orderstatus = 'F') AS pinned FROM ob")
def pinned_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned = tables.read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select((F.col("o_orderkey") * 10 + 1).alias("address"), F.lit(True).alias("is_pinned")).distinct()
    return _objects(spark, sf_dir).join(pinned, "address", "left").select("segment", "address", F.coalesce("is_pinned", F.lit(False)).alias("pinned"))


@query("A37_generation_stats", f"WITH {OBJECTS} SELECT generation, count(*) FILTER (NOT is_free) AS objects, CAST(coalesce(sum(size) FILTER (NOT is_free), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(size) FILTER (is_free), 0) AS BIGINT) AS free_bytes, round(coalesce(sum(size) FILTER (is_free), 0) * 100.0 / sum(size), 2) AS fragmentation FROM ob GROUP BY 1")
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.generation_stats(_objects(spark, sf_dir))


@query("A38_largest_types", f"WITH {OBJECTS} SELECT type, generation, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ob WHERE NOT is_free AND size >= 30000 GROUP BY ALL ORDER BY bytes DESC, type, generation LIMIT 50")
def largest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _objects(spark, sf_dir).filter("NOT is_free AND size >= 30000").groupBy("type", "generation").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return rank.top(sums, [F.desc("bytes"), F.col("type"), F.col("generation")], 50)


@query("A39_segment_occupancy", f"WITH {OBJECTS} SELECT segment, round(coalesce(sum(size) FILTER (NOT is_free), 0) * 100.0 / sum(size), 2) AS occupancy, count(*) AS n FROM ob GROUP BY 1")
def segment_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.segment_occupancy(_objects(spark, sf_dir))


@query("W4_block_runs", f"WITH {OBJECTS}, c AS (SELECT *, CASE WHEN lag(is_free) OVER w <> is_free THEN 1 ELSE 0 END AS chg FROM ob WINDOW w AS (PARTITION BY segment ORDER BY address)), r AS (SELECT *, sum(chg) OVER (PARTITION BY segment ORDER BY address) AS run FROM c), t AS (SELECT segment, run, is_free, type, sum(size) AS b, count(*) AS n, min(address) AS st FROM r GROUP BY ALL) SELECT segment, CAST(run AS BIGINT) AS run, is_free, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS bytes, min(st) AS start, arg_max(type, (b, type)) AS dominant FROM t GROUP BY ALL")
def block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.block_runs(_objects(spark, sf_dir, "segment"))


#: Nodes are whole numbers: eight times the key, and the place of the table here. The root is 0.
KINDS = ("root", "region", "nation", "customer", "order", "part")
ROOT = 0


def _node(kind: str, key: F.Column) -> F.Column:
    return key.cast("bigint") * 8 + KINDS.index(kind)


def _heap_graph(spark: SparkSession, sf_dir: str, repeated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers, orders and the parts they share, below one root; `repeated` leaves a part's edges as often as an order has it."""
    region, nation, customer, orders, line, part = (tables.read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem", "part"))
    node = lambda kind, key: _node(kind, F.col(key))
    tall = lambda df, kind, key, size: df.select(node(kind, key).alias("node"), F.lit(kind).alias("type"), size.cast("bigint").alias("size"))
    nodes = tall(region, "region", "r_regionkey", F.lit(1)).unionByName(tall(nation, "nation", "n_nationkey", F.lit(2))).unionByName(tall(customer, "customer", "c_custkey", F.floor(F.abs("c_acctbal"))))
    nodes = nodes.unionByName(tall(orders, "order", "o_orderkey", F.floor("o_totalprice"))).unionByName(tall(part, "part", "p_partkey", F.floor("p_retailprice")))
    nodes = nodes.unionByName(spark.range(1).select(F.lit(ROOT).cast("bigint").alias("node"), F.lit("root").alias("type"), F.lit(0).cast("bigint").alias("size")))
    link = lambda df, a, x, b, y: df.select(node(a, x).alias("src"), node(b, y).alias("dst"), F.col(y).cast("bigint").alias("ordinal"))
    edges = region.select(F.lit(ROOT).cast("bigint").alias("src"), node("region", "r_regionkey").alias("dst"), F.col("r_regionkey").cast("bigint").alias("ordinal"))
    sold = line.select("l_orderkey", "l_partkey")
    for more in (link(nation, "region", "n_regionkey", "nation", "n_nationkey"), link(customer, "nation", "c_nationkey", "customer", "c_custkey"), link(orders, "customer", "o_custkey", "order", "o_orderkey"), link(sold if repeated else sold.distinct(), "order", "l_orderkey", "part", "l_partkey")):
        edges = edges.unionByName(more)
    return nodes, edges


def _named(column: str):
    """A node's letter and key, as R3 or O17; the root is `root`."""
    node = F.col(column)
    letter = F.element_at(F.array(*[F.lit(k[0].upper()) for k in KINDS]), (node % 8 + 1).cast("int"))
    return F.when(node == ROOT, F.lit("root")).otherwise(F.concat(letter, F.floor(node / 8))).alias(column)


TREE = "tr AS (SELECT r_regionkey AS r, n_nationkey AS n, c_custkey AS c, o_orderkey AS o, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


ABOVE = "SELECT 'root' AS node, NULL AS above, 0 AS depth UNION ALL SELECT concat('R', r_regionkey), 'root', 1 FROM region UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey), 2 FROM nation UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey), 3 FROM customer UNION ALL SELECT concat('O', o_orderkey), concat('C', o_custkey), 4 FROM orders"


@query("G1_breadth_first", f"WITH {TREE} SELECT node, above AS parent, depth FROM ({ABOVE}) UNION ALL SELECT concat('P', p), concat('O', arg_min(o, (r, n, c, o))), 5 FROM tr GROUP BY p")
def breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _heap_graph(spark, sf_dir)
    return graph.breadth_first(edges, ROOT).select(_named("node"), _named("parent"), "depth")


@query("G2_depth_first", f"""WITH {TREE}, fp AS (SELECT p, min((r, n, c, o)) AS w FROM tr GROUP BY p), al AS (SELECT 'root' AS node, CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS o, CAST(NULL AS BIGINT) AS p
UNION ALL SELECT concat('R', r_regionkey), r_regionkey, NULL, NULL, NULL, NULL FROM region UNION ALL SELECT concat('N', n_nationkey), n_regionkey, n_nationkey, NULL, NULL, NULL FROM nation
UNION ALL SELECT concat('C', c_custkey), n_regionkey, n_nationkey, c_custkey, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('O', o_orderkey), n_regionkey, n_nationkey, c_custkey, o_orderkey, NULL FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('P', p), w[1], w[2], w[3], w[4], p FROM fp)
SELECT node, row_number() OVER (ORDER BY r NULLS FIRST, n NULLS FIRST, c NULLS FIRST, o NULLS FIRST, p NULLS FIRST) - 1 AS place FROM al""")
def depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pre-order of the tree of first discoverers, children by their keys."""
    _, edges = _heap_graph(spark, sf_dir)
    tree = graph.breadth_first(edges, ROOT).select("node", "parent", F.floor(F.col("node") / 8).alias("ordinal"))
    return dominator_tree.depth_first(tree).select(_named("node"), "place")


PARTS = "pd AS (SELECT p, CASE WHEN count(DISTINCT o) = 1 THEN min(o) END AS o, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS c, CASE WHEN count(DISTINCT n) = 1 THEN min(n) END AS n, CASE WHEN count(DISTINCT r) = 1 THEN min(r) END AS r FROM tr GROUP BY p)"


@query("G3_dominators", f"WITH {TREE}, {PARTS} SELECT node, above AS dominator FROM ({ABOVE}) UNION ALL SELECT concat('P', p), CASE WHEN o IS NOT NULL THEN concat('O', o) WHEN c IS NOT NULL THEN concat('C', c) WHEN n IS NOT NULL THEN concat('N', n) WHEN r IS NOT NULL THEN concat('R', r) ELSE 'root' END FROM pd")
def dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _heap_graph(spark, sf_dir, repeated=True)
    return dominator_tree.dominators(edges, ROOT).select(_named("node"), _named("dominator"))


#: Every node with its dominators of each level and its bytes, and what each node keeps alive.
KEPT = """sz AS (SELECT 'root' AS node, 'root' AS type, NULL AS r, NULL AS n, NULL AS c, NULL AS o, NULL AS p, CAST(0 AS BIGINT) AS b UNION ALL SELECT concat('R', r_regionkey), 'region', r_regionkey, NULL, NULL, NULL, NULL, 1 FROM region
UNION ALL SELECT concat('N', n_nationkey), 'nation', n_regionkey, n_nationkey, NULL, NULL, NULL, 2 FROM nation UNION ALL SELECT concat('C', c_custkey), 'customer', n_regionkey, n_nationkey, c_custkey, NULL, NULL, CAST(floor(abs(c_acctbal)) AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('O', o_orderkey), 'order', n_regionkey, n_nationkey, c_custkey, o_orderkey, NULL, CAST(floor(o_totalprice) AS BIGINT) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('P', p), 'part', r, n, c, o, p, CAST(floor(p_retailprice) AS BIGINT) FROM pd JOIN part ON p = p_partkey),
kp AS (SELECT 'root' AS node, sum(b) AS retained FROM sz UNION ALL SELECT concat('R', r), sum(b) FROM sz WHERE r IS NOT NULL GROUP BY r UNION ALL SELECT concat('N', n), sum(b) FROM sz WHERE n IS NOT NULL GROUP BY n UNION ALL SELECT concat('C', c), sum(b) FROM sz WHERE c IS NOT NULL GROUP BY c
UNION ALL SELECT concat('O', o), sum(b) FROM sz WHERE o IS NOT NULL GROUP BY o UNION ALL SELECT concat('P', p), sum(b) FROM sz WHERE p IS NOT NULL GROUP BY p)"""


@query("G4_retained_sizes", f"WITH {TREE}, {PARTS}, {KEPT} SELECT node, CAST(retained AS BIGINT) AS retained FROM kp")
def retained_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _heap_graph(spark, sf_dir, repeated=True)
    return graph.retained_sizes(nodes, dominator_tree.dominators(edges, ROOT)).select(_named("node"), "retained")


@query("A34_type_census", f"WITH {TREE}, {PARTS}, {KEPT}, m AS (SELECT count(*) AS n, CAST(coalesce(sum(floor(p_retailprice)), 0) AS BIGINT) AS b FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) SELECT type, count(*) + CASE WHEN type = 'part' THEN (SELECT n FROM m) ELSE 0 END AS n, CAST(sum(b) + CASE WHEN type = 'part' THEN (SELECT b FROM m) ELSE 0 END AS BIGINT) AS exclusive, CAST(sum(retained) AS BIGINT) AS retained, CAST(max(retained) AS BIGINT) AS max_retained, CASE WHEN type = 'part' THEN (SELECT n FROM m) ELSE 0 END AS unreachable FROM sz JOIN kp USING (node) GROUP BY type")
def type_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _heap_graph(spark, sf_dir, repeated=True)
    return graph.census(nodes, dominator_tree.dominators(edges, ROOT)).select("type", "n", "exclusive", "retained", "max_retained", "unreachable")


@query("A36_type_edges", "SELECT 'order' AS from_type, 'part' AS to_type, count(*) AS n, CAST(sum(floor(p_retailprice)) AS BIGINT) AS bytes FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'customer', 'order', count(*), CAST(sum(floor(o_totalprice)) AS BIGINT) FROM orders UNION ALL SELECT 'nation', 'customer', count(*), CAST(sum(floor(abs(c_acctbal))) AS BIGINT) FROM customer UNION ALL SELECT 'region', 'nation', count(*), CAST(count(*) * 2 AS BIGINT) FROM nation UNION ALL SELECT 'root', 'region', count(*), count(*) FROM region")
def type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_edges(*_heap_graph(spark, sf_dir))


#: The objects of each type, and the types on the way from the root down to it.
WAYS = """ob AS (SELECT 'region' AS type, 1 AS b FROM region UNION ALL SELECT 'nation', 2 FROM nation UNION ALL SELECT 'customer', floor(abs(c_acctbal)) FROM customer
  UNION ALL SELECT 'order', floor(o_totalprice) FROM orders UNION ALL SELECT 'part', floor(p_retailprice) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
wy AS (SELECT type, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes, list_position(['root', 'region', 'nation', 'customer', 'order', 'part'], type) AS place FROM ob GROUP BY type)"""


@query("G5_root_paths", f"""WITH {WAYS} SELECT type AS first_type, d AS depth, n, bytes,
  array_to_string(list_reverse((['root', 'region', 'nation', 'customer', 'order', 'part'])[place - d:place]), '<') AS path FROM wy, range(0, 6) r(d) WHERE d < place""")
def root_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _heap_graph(spark, sf_dir)
    tree = graph.root_paths(nodes, graph.breadth_first(edges, ROOT).select("node", "parent"))
    return graph.path_names(tree).select(F.substring_index("path", "<", 1).alias("first_type"), F.col("depth").cast("bigint").alias("depth"), "n", "bytes", "path")


@query("G7_reference_totals", "SELECT s_name AS type, count(*) AS n, CAST(sum(c) AS BIGINT) AS refs FROM (SELECT s_name, p_brand, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, p_brand QUALIFY row_number() OVER (PARTITION BY s_name ORDER BY count(*) DESC, p_brand) <= 8) GROUP BY 1")
def reference_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, supplier = (tables.read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    pairs = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("c")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    capped = rank.per_group(pairs.groupBy("s_name", "p_brand").agg(F.sum("c").alias("c")), ["s_name"], [F.desc("c"), F.col("p_brand")], 8)
    return capped.groupBy(F.col("s_name").alias("type")).agg(F.count("*").alias("n"), F.sum("c").alias("refs"))
