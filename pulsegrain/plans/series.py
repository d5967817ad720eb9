"""Series, ranks and shares beside the summaries of events and structure, from the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import buckets, graph, heap, rank, stacks, threads
from ..sources import tables
from .events import contentions
from .registry import ALLOC, CON, EV, EXC, STACKS, query
from .structure import NODES, OBJECTS, RANKED, _nodes, _objects, _path


@query("A6_exception_series", f"""WITH {EXC}, s AS (SELECT min(rel_ms) AS lo, max(rel_ms) AS hi, least(count(*), 100) AS n FROM ex), t AS (SELECT type_name FROM ex GROUP BY 1 ORDER BY count(*) DESC, type_name LIMIT 10)
SELECT type_name, CAST(least(floor((rel_ms - lo) / ((hi - lo) / n)), n - 1) AS INTEGER) AS bucket, count(*) AS n FROM ex JOIN t USING (type_name), s GROUP BY ALL""")
def exception_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.series(tables.exceptions(tables.trace_events(spark, sf_dir)), "rel_ms", "type_name", 10)


@query("A7_contention_histogram", f"""WITH {CON}, s AS (SELECT min(start_ms) AS lo, max(start_ms) AS hi, least(count(*), 100) AS n FROM co), b AS (
  SELECT CAST(least(floor((start_ms - lo) / ((hi - lo) / n)), n - 1) AS INTEGER) AS bucket, duration_ms FROM co, s
) SELECT CAST(g AS INTEGER) AS bucket, count(b.bucket) AS n, coalesce(round(sum(b.duration_ms), 3), 0) AS wait_ms FROM range((SELECT n FROM s)) r(g) LEFT JOIN b ON b.bucket = g GROUP BY 1""")
def contention_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits go with the bucket that they start in."""
    return buckets.histogram(contentions(spark, sf_dir), "start_ms", {"n": F.count("*"), "wait_ms": F.round(F.sum("duration_ms"), 3)})


@query("A8_lock_ranks", f"""WITH {CON}, w AS (SELECT DISTINCT tid FROM ev WHERE kind = 'signup' AND k % 2 = 0), g AS (
  SELECT lock_id, count(*) AS n, sum(duration_ms) AS total, max(duration_ms) AS max_ms, count(DISTINCT tid) AS waiters, count(DISTINCT tid) FILTER (tid IN (SELECT tid FROM w)) AS worker_waiters, count(*) FILTER (tid IN (SELECT tid FROM w)) AS worker_waits FROM co WHERE lock_id <> 0 GROUP BY 1)
SELECT lock_id, CAST(row_number() OVER (ORDER BY total DESC, lock_id) AS INTEGER) AS rank, n, round(total, 3) AS total_ms, max_ms, waiters, worker_waiters, worker_waits FROM g""")
def lock_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with an even sign-up stand for the pool's workers."""
    workers = tables.trace_events(spark, sf_dir).filter("kind = 'signup' AND k % 2 = 0").select("tid").distinct()
    return threads.lock_ranks(contentions(spark, sf_dir), workers)


@query("A13_method_series", f"""WITH {EV}, sa AS (SELECT * FROM ev WHERE kind = 'view'), s AS (SELECT min(rel_ms) AS lo, max(rel_ms) AS hi FROM sa), t AS (SELECT k FROM sa GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 8)
SELECT k AS method, CAST(least(floor((rel_ms - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bucket, count(*) AS n FROM sa JOIN t USING (k), s GROUP BY ALL""")
def method_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self samples of the methods with most of them, in 100 buckets."""
    samples = tables.trace_events(spark, sf_dir).filter("kind = 'view'").withColumnRenamed("k", "method")
    return buckets.series(samples, "rel_ms", "method", 8, fixed=100)


@query("A18_pool_summary", f"""WITH {EV} SELECT max(k) AS peak, min(k) AS lowest, arg_max(k, seq) AS final, count(*) FILTER (kind = 'signup') AS starts, count(*) FILTER (kind = 'error') AS stops, count(*) FILTER (kind = 'click') AS waits, round(avg(value) FILTER (kind = 'view'), 6) AS throughput FROM ev""")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return ev.agg(
        F.max("k").alias("peak"), F.min("k").alias("lowest"), F.max_by("k", "seq").alias("final"), of("signup").alias("starts"), of("error").alias("stops"), of("click").alias("waits"), F.round(F.avg(F.when(F.col("kind") == "view", F.col("value"))), 6).alias("throughput")
    )


@query("A18_throughput_series", f"""WITH {EV}, v AS (SELECT * FROM ev WHERE kind = 'view'), s AS (SELECT min(rel_ms) AS lo, max(rel_ms) AS hi FROM v), b AS (SELECT CAST(least(floor((rel_ms - lo) / ((hi - lo) / 200)), 199) AS INTEGER) AS bucket, value FROM v, s)
SELECT CAST(g AS INTEGER) AS bucket, coalesce(round(avg(value), 6), 0) AS throughput FROM range(200) r(g) LEFT JOIN b ON b.bucket = g GROUP BY 1""")
def throughput_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.trace_events(spark, sf_dir).filter("kind = 'view'")
    return buckets.histogram(samples, "rel_ms", {"throughput": F.round(F.avg("value"), 6)}, fixed=200)


@query("A22_gc_share", f"WITH {EV} SELECT round(sum(value) FILTER (kind = 'signup') * 100 / (max(rel_ms) - min(rel_ms)), 9) AS gc_percent FROM ev")
def gc_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the capture that collections pause, of none if it has no length."""
    span = F.max("rel_ms") - F.min("rel_ms")
    paused = F.sum(F.when(F.col("kind") == "signup", F.col("value")))
    return tables.trace_events(spark, sf_dir).agg(F.when(span > 0, F.round(paused * 100 / span, 9)).alias("gc_percent"))


@query("A24_more_metrics", f"""WITH {CON} SELECT 'contention' AS dimension, concat('S', stack_index) AS name, count(*) AS n, round(sum(duration_ms), 3) AS amount FROM co GROUP BY stack_index
UNION ALL SELECT 'cpu', concat('F', k), count(*), CAST(count(*) AS DOUBLE) FROM ev WHERE kind = 'view' GROUP BY k UNION ALL SELECT 'gc', concat('gen', k % 3), count(*), round(sum(value), 3) FROM ev WHERE kind = 'signup' GROUP BY k % 3""")
def more_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits by site, self samples by frame, and pauses by generation, as named metrics."""
    ev = tables.trace_events(spark, sf_dir)
    one = lambda df, dimension, name, amount: df.groupBy(name.alias("name")).agg(F.count("*").alias("n"), amount.alias("amount")).withColumn("dimension", F.lit(dimension))
    waits = one(contentions(spark, sf_dir), "contention", F.concat(F.lit("S"), "stack_index"), F.round(F.sum("duration_ms"), 3))
    cpu = one(ev.filter("kind = 'view'"), "cpu", F.concat(F.lit("F"), "k"), F.count("*").cast("double"))
    pauses = one(ev.filter("kind = 'signup'"), "gc", F.concat(F.lit("gen"), F.col("k") % 3), F.round(F.sum("value"), 3))
    return waits.unionByName(cpu).unionByName(pauses).select("dimension", "name", "n", "amount")


@query("A31_gc_percent", f"""WITH {ALLOC}, g AS (SELECT tid % 8 AS pid, sum(value) AS pause, max(rel_ms + value) - min(rel_ms) AS span FROM ev WHERE kind = 'signup' GROUP BY 1), a AS (SELECT tid % 8 AS pid, CAST(sum(bytes) AS BIGINT) AS bytes FROM al GROUP BY 1)
SELECT pid, CASE WHEN span > 0 THEN round(pause * 100 / span, 9) END AS gc_percent, bytes FROM g LEFT JOIN a USING (pid)""")
def gc_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses of a process as part of the time from its first collection's start to the last one's end."""
    ev = tables.trace_events(spark, sf_dir).withColumn("pid", F.col("tid") % 8)
    span = F.max(F.col("rel_ms") + F.col("value")) - F.min("rel_ms")
    gcs = ev.filter("kind = 'signup'").groupBy("pid").agg(F.when(span > 0, F.round(F.sum("value") * 100 / span, 9)).alias("gc_percent"))
    sizes = tables.allocations(ev).groupBy((F.col("tid") % 8).alias("pid")).agg(F.sum("bytes").alias("bytes"))
    return gcs.join(sizes, "pid", "left")


EDGES = "eg AS (SELECT p_brand AS from_type, concat('N', s_nationkey) AS to_type, count(*) AS n, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS bytes FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


@query("A36_capped_edges", f"WITH {EDGES} SELECT from_type, to_type, n, bytes, CAST(row_number() OVER o AS INTEGER) AS out_rank, CAST(row_number() OVER i AS INTEGER) AS in_rank FROM eg WINDOW o AS (PARTITION BY from_type ORDER BY bytes DESC, n DESC, to_type), i AS (PARTITION BY to_type ORDER BY bytes DESC, n DESC, from_type) QUALIFY out_rank <= 6 OR in_rank <= 6")
def capped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between types with the heaviest few of each type and direction; a real capture keeps 64."""
    line, part, supplier = (tables.read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    sums = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum(F.floor("l_extendedprice")).alias("bytes"))
    named = sums.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = named.groupBy(F.col("p_brand").alias("from_type"), F.concat(F.lit("N"), "s_nationkey").alias("to_type")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return graph.capped_edges(edges, 6)


@query("A37_free_histogram", f"""WITH {OBJECTS} SELECT generation, CASE WHEN size < 1024 THEN 0 WHEN size < 8192 THEN 1024 WHEN size < 85000 THEN 8192 WHEN size < 1048576 THEN 85000 ELSE 1048576 END AS low,
  CASE WHEN size < 1024 THEN 1023 WHEN size < 8192 THEN 8191 WHEN size < 85000 THEN 84999 WHEN size < 1048576 THEN 1048575 ELSE -1 END AS high, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ob WHERE is_free GROUP BY ALL""")
def free_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.free_histogram(_objects(spark, sf_dir))


PINNED = f"{OBJECTS}, pn AS (SELECT *, address IN (SELECT o_orderkey * 10 + 1 FROM orders WHERE o_orderstatus = 'F') AS pinned FROM ob)"


def _pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned = tables.read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select((F.col("o_orderkey") * 10 + 1).alias("address"), F.lit(True).alias("is_pinned")).distinct()
    return _objects(spark, sf_dir).join(pinned, "address", "left").withColumn("pinned", F.coalesce("is_pinned", F.lit(False))).drop("is_pinned")


@query("A38_pinned_types", f"WITH {PINNED} SELECT type, generation, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM pn WHERE pinned AND NOT is_free GROUP BY ALL")
def pinned_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pinned(spark, sf_dir).filter("pinned AND NOT is_free").groupBy("type", "generation").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("W4_prefix_runs", f"""WITH {PINNED}, f AS (SELECT *, first_value(generation) OVER (PARTITION BY segment ORDER BY address) AS prime FROM pn), p AS (SELECT *, count(*) FILTER (generation <> prime) OVER (PARTITION BY segment ORDER BY address) AS passed FROM f),
c AS (SELECT *, CASE WHEN lag(is_free) OVER w <> is_free THEN 1 ELSE 0 END AS chg FROM p WHERE passed = 0 WINDOW w AS (PARTITION BY segment ORDER BY address)), r AS (SELECT *, sum(chg) OVER (PARTITION BY segment ORDER BY address) AS run FROM c),
t AS (SELECT segment, run, is_free, type, sum(size) AS b, count(*) AS n, min(address) AS st, bool_or(pinned) AS pinned FROM r GROUP BY ALL), d AS (SELECT *, arg_max(type, (b, type)) OVER (PARTITION BY segment, run) AS top FROM t)
SELECT segment, CAST(run AS BIGINT) AS run, is_free, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS bytes, min(st) AS start, min(top) AS dominant, count(*) - 1 AS other_types, bool_or(pinned) AS pinned FROM d GROUP BY ALL""")
def prefix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs within the first generation of a segment only, with what else they hold."""
    return heap.block_runs(heap.generation_prefix(_pinned(spark, sf_dir)), pinned="pinned")


@query("W6_sibling_caps", f"WITH {STACKS}, {NODES}, {RANKED} SELECT path, CAST(sibling AS INTEGER) AS sibling, weight FROM rk WHERE sibling <= 12")
def sibling_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 12 children of a caller, heaviest first."""
    marked = stacks.ranked_siblings(_nodes(spark, sf_dir), "weight").filter("sibling <= 12")
    return _path(marked).select("path", "sibling", "weight")


@query("A35_by_generation", f"WITH {OBJECTS}, g AS (SELECT generation, type, CAST(sum(size) AS BIGINT) AS bytes FROM ob WHERE NOT is_free GROUP BY ALL) SELECT generation, type, bytes, CAST(row_number() OVER (PARTITION BY generation ORDER BY bytes DESC, type) AS INTEGER) AS rank FROM g QUALIFY rank <= 10")
def largest_by_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _objects(spark, sf_dir).filter("NOT is_free").groupBy("generation", "type").agg(F.sum("size").alias("bytes"))
    return rank.per_group(sums, ["generation"], [F.desc("bytes"), F.col("type")], 10)
