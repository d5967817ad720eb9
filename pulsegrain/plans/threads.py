"""Queries over threads, pools, compiled methods and heaps of the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import diff, gc, rank, temporal, threads
from ..sources import tables
from .registry import EV, query

@query("A15_top_stacks", f"WITH {EV}, c AS (SELECT tid, k AS stack_index, count(*) AS n FROM ev WHERE kind = 'view' GROUP BY ALL) SELECT tid, stack_index, n, CAST(row_number() OVER (PARTITION BY tid ORDER BY n DESC, stack_index) AS INTEGER) AS place FROM c QUALIFY place <= 3")
def top_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.top_stacks(tables.trace_events(spark, sf_dir).filter("kind = 'view'").select("tid", F.col("k").alias("stack_index")))


@query("A20_adjustment_groups", f"""WITH {EV}, ad AS (SELECT seq AS adj, rel_ms AS at_ms FROM ev WHERE kind = 'signup'), m AS (SELECT adj, tid, arg_min(k % 6, [at_ms - rel_ms, CAST(seq AS DOUBLE)]) AS stack, min(at_ms - rel_ms) AS age FROM ad JOIN ev ON kind = 'view' AND at_ms - rel_ms >= 0 AND at_ms - rel_ms <= 3600000 GROUP BY ALL)
SELECT adj, stack, count(*) AS n, list(tid ORDER BY tid)[1] AS first_tid, round(max(age), 3) AS oldest_ms FROM m GROUP BY ALL""")
def adjustment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    adj = ev.filter("kind = 'signup'").select(F.col("seq").alias("adj"), F.col("rel_ms").alias("at"))
    views = ev.filter("kind = 'view'").withColumn("stack", F.col("k") % 6)
    met = temporal.asof_groups(adj, views, "at", "rel_ms", 3_600_000.0, "tid", "seq", ["stack"])
    return adj.join(met, "at").select("adj", "stack", "n", "first_tid", F.round(F.col("at") - F.col("oldest"), 3).alias("oldest_ms"))


@query("A21_stall_leaves", f"WITH {EV}, t AS (SELECT rel_ms AS at_ms FROM ev WHERE kind = 'error' AND k < 60), s AS (SELECT k FROM ev WHERE kind = 'view' AND k % 9 <> 0 AND EXISTS (SELECT 1 FROM t WHERE ev.rel_ms >= at_ms - 600000 AND ev.rel_ms <= at_ms)), g AS (SELECT k % 2 = 0 AS benign, k AS leaf, count(*) AS n FROM s GROUP BY ALL) SELECT benign, leaf, n FROM g QUALIFY row_number() OVER (PARTITION BY benign ORDER BY n DESC, leaf) <= 40")
def stall_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    stalls = ev.filter("kind = 'error' AND k < 60").select(F.col("rel_ms").alias("at_ms"))
    inside = temporal.within_windows(ev.filter("kind = 'view' AND k % 9 <> 0"), stalls, "rel_ms", "at_ms", 600_000.0)
    leaves = inside.groupBy((F.col("k") % 2 == 0).alias("benign"), F.col("k").alias("leaf")).agg(F.count("*").alias("n"))
    return rank.per_group(leaves, ["benign"], [F.desc("n"), F.col("leaf")], 40).drop("rank")


@query("A24_named_metrics", f"WITH {EV} SELECT 'event' AS dimension, kind AS name, count(*) AS n, CAST(0 AS DOUBLE) AS amount FROM ev GROUP BY kind UNION ALL SELECT 'allocation', concat('T', k % 20), count(*), round(sum(value), 6) FROM ev WHERE kind = 'purchase' GROUP BY k % 20 UNION ALL SELECT 'exception', concat('E', k % 60), count(*), round(sum(value), 6) FROM ev WHERE kind = 'error' GROUP BY k % 60")
def named_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    one = lambda d, n, a: F.struct(F.lit(d).alias("dimension"), n.alias("name"), a.cast("double").alias("amount"))
    extra = F.when(F.col("kind") == "purchase", one("allocation", F.concat(F.lit("T"), F.col("k") % 20), F.col("value"))).when(F.col("kind") == "error", one("exception", F.concat(F.lit("E"), F.col("k") % 60), F.col("value")))
    # one pass serves all dimensions
    each = ev.select(F.explode(F.array_compact(F.array(one("event", F.col("kind"), F.lit(0.0)), extra))).alias("m")).select("m.*")
    return each.groupBy("dimension", "name").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 6).alias("amount"))


@query("W9_diff_rank", "WITH a AS (SELECT p_brand AS name, count(*) AS n, sum(l_quantity) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT p_brand AS name, count(*) AS n, sum(l_quantity) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1), d AS (SELECT coalesce(a.name, b.name) AS name, coalesce(b.n, 0) - coalesce(a.n, 0) AS count_change, round(coalesce(b.amount, 0) / 20 - coalesce(a.amount, 0) / 10, 6) AS rate_change FROM a FULL JOIN b ON a.name = b.name) SELECT * FROM d ORDER BY abs(rate_change) DESC, abs(count_change) DESC, name LIMIT 12")
def diff_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = tables.read(spark, sf_dir, "lineitem"), tables.read(spark, sf_dir, "part")
    sums = line.filter(F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("amount"))
    named = sums.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_returnflag", F.col("p_brand").alias("name")).agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    rows = diff.compare(named.filter("l_returnflag = 'A'"), named.filter("l_returnflag = 'R'"), 10.0, 20.0)
    return diff.ranked(rows, 12).select("name", "count_change", "rate_change")


@query("W10_ranked_table", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50")
def ranked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "customer").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(50).select("c_custkey", "c_acctbal")


HEAPS = "hp AS (SELECT o_orderkey AS gc_id, l_linenumber % 3 AS generation, CAST(floor(l_extendedprice) AS BIGINT) AS size_before, CAST(floor(l_quantity * 50) AS BIGINT) AS free_list, CAST(floor(l_tax * 10000) AS BIGINT) AS free_obj, CAST(floor(l_quantity * 3) AS BIGINT) AS pinned, CAST(floor(l_extendedprice / 3) AS BIGINT) AS survived FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.read(spark, sf_dir, "lineitem").join(tables.read(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    whole = lambda e: F.floor(e).cast("bigint")
    return line.select(F.col("o_orderkey").alias("gc_id"), (F.col("l_linenumber") % 3).alias("generation"), whole(F.col("l_extendedprice")).alias("size_before"), whole(F.col("l_quantity") * 50).alias("free_list"), whole(F.col("l_tax") * 10000).alias("free_obj"), whole(F.col("l_quantity") * 3).alias("pinned"), whole(F.col("l_extendedprice") / 3).alias("survived"))


@query("P4_generation_columns", f"WITH {HEAPS} SELECT generation, CAST(sum(size_before - free_list - free_obj) AS BIGINT) AS obj_space, CAST(sum(free_list + free_obj) AS BIGINT) AS fragmentation, CAST(sum(pinned + survived) AS BIGINT) AS outs, CAST(sum(CASE WHEN size_before - free_list - free_obj > 0 THEN floor((pinned + survived) * 100 / (size_before - free_list - free_obj)) ELSE 0 END) AS BIGINT) AS rates FROM hp GROUP BY 1")
def generation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _heaps(spark, sf_dir).withColumns(gc.derived_generation("size_before", "free_list", "free_obj", "pinned", "survived"))
    return rows.groupBy("generation").agg(F.sum("obj_space").alias("obj_space"), F.sum("fragmentation").alias("fragmentation"), F.sum("out").alias("outs"), F.sum("surv_rate").alias("rates"))


@query("A26_allocation_between_gcs", f"WITH {HEAPS}, g AS (SELECT gc_id, sum(size_before) / 1024.0 AS kb FROM hp GROUP BY 1) SELECT round(avg(kb), 6) AS mean_kb, round(max(kb), 6) AS max_kb, round(min(kb), 6) AS min_kb FROM g")
def allocation_between_gcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = _heaps(spark, sf_dir).groupBy("gc_id").agg((F.sum("size_before") / 1024.0).alias("kb"))
    return kb.agg(F.round(F.avg("kb"), 6).alias("mean_kb"), F.round(F.max("kb"), 6).alias("max_kb"), F.round(F.min("kb"), 6).alias("min_kb"))


@query("A27_heap_fields", f"WITH {HEAPS} SELECT gc_id, CAST(sum(pinned) AS BIGINT) AS pinned, round(avg(survived), 6) AS mean_survived FROM hp GROUP BY 1")
def heap_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heaps(spark, sf_dir).groupBy("gc_id").agg(F.sum("pinned").alias("pinned"), F.round(F.avg("survived"), 6).alias("mean_survived"))


@query("A28_fragmentation", f"WITH {HEAPS} SELECT gc_id, round(sum(CASE WHEN generation = 2 THEN free_list + free_obj ELSE 0 END) * 100.0 / sum(size_before), 6) AS gen2_percent, round(sum(free_list + free_obj) * 100.0 / sum(size_before), 6) AS total_percent, (gc_id & 4) <> 0 AS compacting FROM hp GROUP BY 1")
def fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = F.col("free_list") + F.col("free_obj")
    sums = _heaps(spark, sf_dir).groupBy("gc_id").agg(F.sum(F.when(F.col("generation") == 2, free).otherwise(0)).alias("gen2"), F.sum(free).alias("all"), F.sum("size_before").alias("size"))
    return sums.select("gc_id", F.round(F.col("gen2") * 100.0 / F.col("size"), 6).alias("gen2_percent"), F.round(F.col("all") * 100.0 / F.col("size"), 6).alias("total_percent"), (F.col("gc_id").bitwiseAND(F.lit(4)) != 0).alias("compacting"))


@query("A29_jit_tiers", f"WITH {EV}, r AS (SELECT k % 3 AS tier, value, row_number() OVER (PARTITION BY k % 3 ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY k % 3) AS c FROM ev WHERE kind = 'view') SELECT tier, count(*) AS n, round(sum(value), 6) AS total, max(value) AS largest, min(value) AS smallest, max(CASE WHEN i = least(CAST(ceil(c / 2.0) AS BIGINT), c - 1) THEN value END) AS median FROM r GROUP BY 1")
def jit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = tables.trace_events(spark, sf_dir).filter("kind = 'view'").withColumn("tier", F.col("k") % 3)
    sums = loads.groupBy("tier").agg(F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("largest"), F.min("value").alias("smallest"))
    medians = rank.grouped_quantiles(loads, ["tier"], "value", {"median": F.least(F.ceil(F.col("n") / 2), F.col("n") - 1)}, F.col("seq"))
    return sums.join(medians, "tier")


@query("A35_interesting_types", "SELECT p_type AS type, CAST(sum(floor(p_retailprice)) AS BIGINT) AS retained, count(*) AS n FROM part GROUP BY 1 ORDER BY retained DESC, type LIMIT 20")
def interesting_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = tables.read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type")).agg(F.sum(F.floor("p_retailprice")).alias("retained"), F.count("*").alias("n"))
    return rank.top(types, [F.desc("retained"), F.col("type")], 20)


@query("P16_generic_names", "SELECT p_partkey, concat('List<', p_brand, '>') AS name FROM part")
def generic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.read(spark, sf_dir, "part")
    return part.select("p_partkey", names.generic_name(F.concat(F.lit("List`1["), "p_brand", F.lit("]"))).alias("name"))


@query("P20_name_parts", "SELECT s_suppkey, concat('Shop.', s_name) AS qualifier, concat('Run<a.', s_suppkey, '>') AS member FROM supplier")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = tables.read(spark, sf_dir, "supplier").withColumn("full", F.concat(F.lit("Shop."), "s_name", F.lit(".Run<a."), "s_suppkey", F.lit(">")))
    qualifier, member = names.qualifier_and_member(F.col("full"))
    return full.select("s_suppkey", qualifier.alias("qualifier"), member.alias("member"))


@query("P25_interned_names", "SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT p_type AS name FROM part)")
def interned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a dictionary of distinct names, as an export needs it
    distinct = tables.read(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    return distinct.select("name", (F.row_number().over(Window.partitionBy().orderBy("name")) - 1).alias("id"))


@query("K8_event_histogram", f"WITH {EV} SELECT kind, k % 10 AS version, count(*) AS n FROM ev GROUP BY ALL")
def event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trace_events(spark, sf_dir).groupBy("kind", (F.col("k") % 10).alias("version")).agg(F.count("*").alias("n"))


@query("J7_gc_correlation")
def gc_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups start collections of a user's capture, every third in the background; the user's other events end and pause them.

    SQL cannot take turns as the heap statistics do; tests compare with a plain walk.
    """
    return gc.correlate(gc_events(spark, sf_dir))


def gc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    one_of = lambda *kinds: F.element_at(F.array(*map(F.lit, kinds)), (F.col("k") % len(kinds) + 1).cast("int"))
    kind = F.when(F.col("kind") == "signup", "start").when(F.col("kind") == "error", "end").when(F.col("kind") == "click", one_of("suspend", "suspend_end", "suspend")).when(F.col("kind") == "purchase", one_of("restart", "global_history", "global_history", "restart"))
    opened = F.count_if(F.col("kind") == "signup").over(Window.partitionBy("tid").orderBy("rel_ms", "seq"))
    gc_id = F.when(F.col("kind") == "error", opened - F.col("k") % 2).otherwise(opened)
    reason = F.when(F.col("kind") == "click", F.when(F.col("k") % 2 == 0, 1).otherwise(6)).otherwise((F.col("k") % 9).cast("int"))
    return ev.select(
        F.col("tid").cast("string").alias("capture"), "seq", "rel_ms", F.coalesce(kind, one_of("heap_stats", "heap_history", "heap_history")).alias("kind"), gc_id.alias("gc_id"), (F.col("k") % 2).cast("int").alias("generation"),
        reason.alias("reason"), F.when(F.col("seq") % 3 == 0, 1).otherwise(0).alias("type"), F.floor(F.col("value") / 20).alias("value"),
    )


@query("J15_sample_kinds", "WITH rg AS (SELECT p_partkey * 100 AS s, p_partkey * 100 + p_size * 4 AS e FROM part), lf AS (SELECT l_partkey * 100 + CAST(l_quantity AS BIGINT) * 3 AS address FROM lineitem), m AS (SELECT DISTINCT address FROM lf WHERE EXISTS (SELECT 1 FROM rg WHERE address >= s AND address < e)) SELECT CASE WHEN m.address IS NULL THEN 'External' ELSE 'Managed' END AS kind, count(*) AS n FROM lf LEFT JOIN m ON lf.address = m.address GROUP BY 1")
def sample_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.read(spark, sf_dir, "part")
    ranges = part.select((F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size") * 4).alias("end"))
    line = tables.read(spark, sf_dir, "lineitem")
    rows = line.count()
    samples = line.select((F.col("l_partkey") * 100 + F.col("l_quantity").cast("bigint") * 3).alias("address"))
    # equal leaves cost a task no memory, so samples are dealt as they are
    leaves = tables.dealt(samples, rows, "address").groupBy("address").agg(F.count("*").alias("n"))
    # each distinct leaf is looked up once and takes its samples along, so that those left over are External
    managed = temporal.range_join(leaves, ranges, "address", "start", "end", rows=rows).select("address", "n").distinct()
    moved = F.array(F.struct(F.lit("Managed").alias("kind"), F.col("n")), F.struct(F.lit("External").alias("kind"), (-F.col("n")).alias("n")))
    kinds = managed.select(F.inline(moved)).unionByName(line.select(F.lit("External").alias("kind"), F.lit(1).cast("long").alias("n")))
    return kinds.groupBy("kind").agg(F.sum("n").alias("n")).filter("n > 0")


@query("P15_method_names", "SELECT p_partkey, concat('Shop.', replace(p_brand, '#', '_')) AS name FROM part")
def method_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.read(spark, sf_dir, "part")
    raw = F.concat(F.lit("[shop] void Shop::"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("(int32,string)[Tier1]"))
    return part.select("p_partkey", names.perf_map_name(raw).alias("name"))


@query("G6_expand_node", "SELECT concat('P', l_partkey) AS node, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 1)) GROUP BY 1")
def expand_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customer 1 reaches in two steps: the expansion of one node in a viewer."""
    from .structure import _heap_graph, _named, _node

    _, edges = _heap_graph(spark, sf_dir)
    first = edges.filter(F.col("src") == _node("customer", F.lit(1))).select(F.col("dst").alias("via"))
    return edges.join(first, edges.src == first.via).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).select(_named("node"), "n")


@query("S7_thread_table", "WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'error')) SELECT user_id AS tid, CAST(event_id AS BIGINT) AS defined_by FROM e WHERE n = 1 AND event_type = 'signup'")
def thread_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads whose last definition (signup) no removal (error) follows."""
    ev = tables.trace_events(spark, sf_dir).filter(F.col("kind").isin("signup", "error"))
    last = ev.groupBy("tid").agg(F.max(F.struct("seq", "kind")).alias("x"))
    return last.filter("x.kind = 'signup'").select("tid", F.col("x.seq").alias("defined_by"))


@query("S8_label_overrides", f"WITH {EV} SELECT seq, coalesce(CASE WHEN k % 3 = 0 THEN k END, c_nationkey) AS level FROM ev LEFT JOIN customer ON tid = c_custkey")
def label_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of the event goes before its metadata."""
    ev = tables.trace_events(spark, sf_dir)
    meta = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tid"), F.col("c_nationkey").cast("bigint").alias("meta"))
    return ev.join(meta, "tid", "left").select("seq", F.coalesce(F.when(F.col("k") % 3 == 0, F.col("k")), "meta").alias("level"))


@query("S11_dynamic_fields", "SELECT event_id AS seq, json_extract_string(props, '$.k') AS k, length(props) AS size FROM events")
def dynamic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-describing fields stay a VARIANT until a query names one."""
    raw = tables.read(spark, sf_dir, "events")
    return raw.select(F.col("event_id").alias("seq"), F.variant_get(F.parse_json("props"), "$.k", "string").alias("k"), F.length("props").cast("bigint").alias("size"))


@query("S14_distinct_roots", "SELECT category, target, count(*) OVER (PARTITION BY category) AS fan_out FROM (SELECT DISTINCT c_mktsegment AS category, c_nationkey AS target FROM customer)")
def distinct_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = tables.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("target")).distinct()
    sizes = roots.groupBy("category").agg(F.count("*").alias("fan_out"))
    return roots.join(F.broadcast(sizes), "category")
