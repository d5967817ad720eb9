"""Queries over decoded payloads, definitions by epoch, live operators in batch form, and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import layouts, names
from ..operators import definitions, graph, heap, jit
from ..sources import files, tables
from ..streaming import live, metrics, projectors
from .registry import EV, query
from .structure import OBJECTS, _objects


def _le(column: str, size: int) -> F.Column:
    return layouts.little_endian(F.expr(column), size)


@query("P3_gc_payloads", f"""WITH {EV} SELECT seq, CAST(k - 50 AS BIGINT) AS reason, seq * 1000003 AS size_0, -k AS promoted_3, CAST(k AS BIGINT) AS pinned, CASE WHEN k % 3 > 0 THEN CAST(k % 7 AS BIGINT) END AS instance,
  CASE WHEN k % 3 = 2 THEN seq + k END AS size_4, CASE WHEN k % 3 = 2 THEN concat('Type', k, '.é😀') END AS type_name, CASE WHEN k % 3 = 2 THEN CAST(k % 4 AS BIGINT) END AS heap, k * 11 AS desired, CAST(k % 5 AS BIGINT) AS heaps FROM ev""")
def gc_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of three versions, built from the events and decoded by their layouts."""
    ev = tables.trace_events(spark, sf_dir).withColumn("version", F.col("k") % 3)
    stats = F.concat(_le("seq * 1000003", 8), *[_le("0", 8)] * 6, _le("-k", 8), _le("0", 8), _le("0", 8), _le("k", 4), _le("0", 4), _le("0", 4), _le("k % 7", 2), F.when(F.col("version") == 2, F.concat(_le("seq + k", 8), _le("0", 8))).otherwise(F.lit(b"")))
    tick = F.concat(_le("k", 4), _le("0", 4), _le("0", 2), _le("k", 8), _le("k", 8), layouts.utf16_bytes(F.concat(F.lit("Type"), F.col("k"), F.lit(".é😀"))), _le("k % 4", 4))
    history = F.concat(_le("k * 11", 8), _le("k % 5", 4), *[_le("0", 4)] * 4)
    made = ev.select("seq", "version", _le("k - 50", 4).alias("suspend"), stats.alias("stats"), tick.alias("tick"), history.alias("history"))
    read = made.select("seq", *[layouts.decode(F.col(c), layout, F.col("version")).alias(c) for c, layout in (("suspend", "suspend"), ("stats", "heap_stats"), ("tick", "allocation_tick"), ("history", "global_history"))])
    return read.select("seq", "suspend.reason", "stats.size_0", "stats.promoted_3", "stats.pinned", "stats.instance", "stats.size_4", "tick.type_name", "tick.heap", F.col("history.youngest_desired").alias("desired"), F.col("history.heaps").alias("heaps"))


@query("P5_runtime_payloads", f"""WITH {EV} SELECT seq, CAST(k % 2 AS BIGINT) AS flags, CASE WHEN k % 3 = 2 THEN seq * 7 END AS lock_id, CASE WHEN k % 3 = 2 THEN -seq END AS owner, CAST(k AS DOUBLE) / 8 AS duration_ns, CAST(-k AS BIGINT) AS retired,
  CAST(k AS BIGINT) AS workers, concat('Space', k) AS namespace, concat('Méthode', seq) AS name, concat('void (', k, ')') AS signature, CAST(seq * 16 AS BIGINT) AS address FROM ev""")
def runtime_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contention, pool and method events; a method's three texts follow each other."""
    ev = tables.trace_events(spark, sf_dir)
    # k / 8 as a double: its sign and exponent and fraction, by the position of the highest bit of k
    bits = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.expr("shiftleft(CAST(1020 + length(bin(k)) - 1 AS BIGINT), 52)") + F.expr("shiftleft(k - shiftleft(1L, length(bin(k)) - 1), 52 - (length(bin(k)) - 1))"))
    start = F.concat(_le("k % 2", 1), _le("0", 2), F.when(F.col("k") % 3 == 2, F.concat(_le("seq * 7", 8), _le("0", 8), _le("-seq", 8))).otherwise(F.lit(b"")))
    stop = F.concat(_le("0", 1), _le("0", 2), layouts.little_endian(bits, 8))
    text = lambda prefix, c, end="": layouts.utf16_bytes(F.concat(F.lit(prefix), F.col(c), F.lit(end)))
    method = F.concat(_le("seq", 8), _le("0", 8), _le("seq * 16", 8), _le("k", 4), _le("0", 4), _le("0", 4), text("Space", "k"), text("Méthode", "seq"), text("void (", "k", ")"))
    parts = {"contention_start": start, "contention_stop": stop, "worker_thread": F.concat(_le("k", 4), _le("-k", 4)), "pool_adjustment": F.concat(_le("0", 8), _le("k", 4), _le("1", 4)), "method": method}
    made = ev.select("seq", *[c.alias(name) for name, c in parts.items()])
    read = made.select("seq", *[layouts.decode(F.col(name), name).alias(name) for name in parts])
    return read.select("seq", "contention_start.flags", "contention_start.lock_id", "contention_start.owner", "contention_stop.duration_ns", "worker_thread.retired", "pool_adjustment.workers", "method.namespace", "method.name", "method.signature", "method.address")


@query("S9_epoch_definitions", f"""WITH {EV}, ep AS (SELECT *, count(*) FILTER (kind = 'error' AND k % 10 = 0) OVER (ORDER BY seq) AS epoch FROM ev), lb AS (
  SELECT *, last_value(CASE WHEN kind = 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY epoch, k % 7 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label,
    last_value(CASE WHEN kind = 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY k % 7 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS survives FROM ep)
SELECT seq, epoch, label, survives FROM lb WHERE kind = 'view'""")
def epoch_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label means what it was last defined as in its epoch; what survives a flush is looked up without the epoch."""
    ev = tables.trace_events(spark, sf_dir).select("seq", "kind", "k", (F.col("k") % 7).alias("slot"))
    placed = definitions.epochs(ev, ev.filter("kind = 'error' AND k % 10 = 0"), "seq")
    given = placed.filter("kind = 'signup'").select("epoch", "slot", "seq", F.col("seq").alias("label"), F.col("seq").alias("survives"))
    uses = placed.filter("kind = 'view'").select("seq", "epoch", "slot")
    found = definitions.resolve(uses, given.select("epoch", "slot", "seq", "label"), "seq", ["epoch", "slot"], "label")
    return definitions.resolve(found, given.select("slot", "seq", "survives"), "seq", ["slot"], "survives").select("seq", "epoch", "label", "survives")


@query("S10_payload_fields", "SELECT l_orderkey, l_linenumber, l_partkey, -l_suppkey AS below, l_linenumber AS small FROM lineitem")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of several sizes written as bytes and read back."""
    fields = (layouts.Field("key", "u4"), layouts.Field("below", "i4"), layouts.Field("small", "i2"))
    line = tables.read(spark, sf_dir, "lineitem")
    payload = F.concat(_le("l_partkey", 4), _le("-l_suppkey", 4), _le("l_linenumber", 2))
    read = line.select("l_orderkey", "l_linenumber", layouts.decode(payload, fields).alias("p"))
    return read.select("l_orderkey", "l_linenumber", F.col("p.key").alias("l_partkey"), "p.below", "p.small")


JIT = f"{EV}, pr AS (SELECT *, k % 5 AS method_id, lag(kind) OVER w AS prior, lag(rel_ms) OVER w AS start_ms FROM ev WHERE kind IN ('click', 'purchase') WINDOW w AS (PARTITION BY tid, k % 5 ORDER BY seq))"


@query("R3_jit_durations", f"WITH {JIT} SELECT tid AS pid, method_id, seq, k % 3 AS tier, row_number() OVER (PARTITION BY tid, method_id ORDER BY seq) > 1 AS tier_up, rel_ms - start_ms AS load_ms FROM pr WHERE kind = 'purchase' AND prior = 'click'")
def jit_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir).filter(F.col("kind").isin("click", "purchase"))
    kind = F.when(F.col("kind") == "click", "start").otherwise("load")
    return jit.jit_durations(ev.select(F.col("tid").alias("pid"), (F.col("k") % 5).alias("method_id"), "seq", kind.alias("kind"), (F.col("k") % 3).alias("tier"), F.col("rel_ms").alias("ts_ms")))


@query("S18_latest_collections", f"WITH {EV}, l AS (SELECT tid AS pid, seq, kind, CAST(floor(value * 1000) AS BIGINT) AS bytes, last_value(CASE WHEN kind = 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gc_id FROM ev) SELECT pid, seq, gc_id, bytes FROM l WHERE kind = 'purchase'")
def latest_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir).filter(F.col("kind").isin("signup", "purchase"))
    kind = F.when(F.col("kind") == "signup", "gc").otherwise("alloc")
    return jit.latest_collections(ev.select(F.col("tid").alias("pid"), "seq", kind.alias("kind"), F.col("seq").alias("gc_id"), F.floor(F.col("value") * 1000).alias("bytes")))


@query("R1_complete_collections", f"""WITH {EV}, e AS (SELECT tid AS pid, seq, CASE kind WHEN 'signup' THEN 'gc_start' WHEN 'view' THEN 'heap' WHEN 'click' THEN 'stats' ELSE 'alloc' END AS kind, value, k FROM ev WHERE kind <> 'error'),
s AS (SELECT *, last_value(CASE WHEN kind = 'gc_start' THEN seq END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY seq) AS gc_id, last_value(CASE WHEN kind = 'gc_start' THEN k % 3 + 1 END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY seq) AS expected FROM e),
c AS (SELECT *, count(*) FILTER (kind = 'heap') OVER w AS heaps, last_value(CASE WHEN kind = 'stats' THEN value END IGNORE NULLS) OVER w AS pause FROM s WHERE kind <> 'alloc' AND gc_id IS NOT NULL WINDOW w AS (PARTITION BY pid, gc_id ORDER BY seq)),
d AS (SELECT pid, gc_id, min(seq) AS seq, arg_min(pause, seq) AS pause, arg_min(heaps, seq) AS heaps FROM c WHERE kind <> 'gc_start' AND pause IS NOT NULL AND heaps >= expected GROUP BY pid, gc_id),
a AS (SELECT e.pid, (SELECT min(d.seq) FROM d WHERE d.pid = e.pid AND d.seq > e.seq) AS seq, CAST(floor(value * 1000) AS BIGINT) AS bytes FROM e WHERE kind = 'alloc')
SELECT d.pid, d.gc_id, d.seq, d.pause, d.heaps, CAST(coalesce(sum(a.bytes), 0) AS BIGINT) AS alloc_bytes, count(a.bytes) AS alloc_ticks FROM d LEFT JOIN a ON a.pid = d.pid AND a.seq = d.seq GROUP BY ALL""")
def complete_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups start a collection of one to three heaps; views are heaps, clicks statistics and purchases allocations of the one that is open."""
    ev = tables.trace_events(spark, sf_dir).filter("kind <> 'error'")
    kind = F.create_map(*[F.lit(x) for x in ("signup", "gc_start", "view", "heap", "click", "stats", "purchase", "alloc")])[F.col("kind")]
    value = F.when(F.col("kind") == "signup", F.col("k") % 3 + 1).when(F.col("kind") == "purchase", F.floor(F.col("value") * 1000)).otherwise(F.col("value"))
    rows = ev.select(F.col("tid").alias("pid"), "seq", kind.alias("kind"), F.when(F.col("kind") == "signup", F.col("seq")).alias("own"), value.cast("double").alias("value"))
    # these events do not say which collection they belong to: to the last that started
    gc_id = F.last("own", ignorenulls=True).over(Window.partitionBy("pid").orderBy("seq"))
    return jit.complete_collections(rows.withColumn("gc_id", gc_id).drop("own"))


@query("R5_sliding_counts", "SELECT CAST(epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * h) AS BIGINT) AS start_us, event_type AS kind, count(*) AS n FROM events, range(0, 4) r(h) GROUP BY ALL")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    return live.event_rates(ev, "24 hours", slide="6 hours").select(F.unix_micros("start").alias("start_us"), "kind", "n")


@query("R5_late_rows", f"WITH {EV}, m AS (SELECT seq, us, max(us) OVER (ORDER BY (seq // 500) * 1000000000 + (tid % 100) * 1000000 + seq % 500 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM ev) SELECT seq, mark - 3600000000 - us AS late_us FROM m WHERE us < mark - 3600000000")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of 500 events are flushed thread by thread, so rows come behind those of other threads."""
    ev = tables.trace_events(spark, sf_dir)
    place = F.expr("(seq div 500) * 1000000000 + (tid % 100) * 1000000 + seq % 500")
    return live.late_rows(ev.withColumn("place", place), "us", "place", 3_600_000_000, cell=20_000_000_000).select("seq", "late_us")


@query("R6_bulk_references", "SELECT l_orderkey AS src, CAST(l_partkey AS BIGINT) AS target, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS ordinal FROM lineitem")
def bulk_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's parts as one bulk payload, which a registered table function reads in SQL."""
    projectors.install(spark)
    line = tables.read(spark, sf_dir, "lineitem")
    each = F.struct("l_linenumber", "l_partkey")
    lists = line.groupBy(F.col("l_orderkey").alias("src")).agg(F.array_sort(F.collect_list(each)).alias("parts"))
    body = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(layouts.little_endian(p["l_partkey"], 8))), ""))
    head = F.concat(_le("0", 4), layouts.little_endian(F.size("parts"), 4), _le("0", 2))
    lists.select("src", F.concat(head, body).alias("payload")).createOrReplaceTempView("bulk_payloads")
    return spark.sql("SELECT src, target, ordinal FROM bulk_payloads, LATERAL bulk_references(payload)")


@query("K6_heap_report", f"""WITH {OBJECTS}, gn AS (SELECT generation, count(*) FILTER (NOT is_free) AS objects, CAST(coalesce(sum(size) FILTER (NOT is_free), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(size) FILTER (is_free), 0) AS BIGINT) AS free_bytes FROM ob GROUP BY 1),
bk AS (SELECT CASE WHEN size < 1000 THEN 0 WHEN size < 10000 THEN 1000 WHEN size < 50000 THEN 10000 ELSE 50000 END AS low, CASE WHEN size < 1000 THEN 1000 WHEN size < 10000 THEN 10000 WHEN size < 50000 THEN 50000 ELSE -1 END AS high, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ob WHERE is_free GROUP BY ALL),
ty AS (SELECT type, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ob WHERE NOT is_free GROUP BY 1 ORDER BY bytes DESC, type LIMIT 5)
SELECT CAST(to_json(struct_pack(objects := (SELECT CAST(sum(objects) AS BIGINT) FROM gn), live_bytes := (SELECT CAST(sum(live_bytes) AS BIGINT) FROM gn), free_bytes := (SELECT CAST(sum(free_bytes) AS BIGINT) FROM gn),
  generations := (SELECT list(struct_pack(generation := generation, objects := objects, live_bytes := live_bytes, free_bytes := free_bytes) ORDER BY generation) FROM gn),
  free_buckets := (SELECT list(struct_pack(low := low, high := high, n := n, bytes := bytes) ORDER BY low) FROM bk),
  largest_types := (SELECT list(struct_pack(type := type, n := n, bytes := bytes) ORDER BY bytes DESC, type) FROM ty))) AS VARCHAR) AS report""")
def heap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap.report(_objects(spark, sf_dir), (1000, 10_000, 50_000), 5)


@query("P14_demangled_names", "SELECT DISTINCT concat(p_brand, '::', replace(p_name, ' ', '_')) AS name FROM part UNION ALL SELECT DISTINCT concat('_Zx', p_brand) FROM part")
def demangled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested names by their lengths; an encoding that is not known stays. Rules run on distinct names."""
    part = tables.read(spark, sf_dir, "part").select("p_brand", F.translate("p_name", " ", "_").alias("member")).distinct()
    sized = lambda c: F.concat(F.length(c).cast("string"), F.col(c))
    nested = part.select(F.concat(F.lit("_ZN"), sized("p_brand"), sized("member"), F.lit("E")).alias("raw"))
    other = part.select(F.concat(F.lit("_Zx"), "p_brand").alias("raw")).distinct()
    return nested.unionByName(other).select(names.demangled("raw").alias("name"))


@query("K5_census_report", f"""WITH {OBJECTS}, t AS (SELECT type, count(*) AS n, CAST(sum(size) AS BIGINT) AS exclusive, CAST(sum(size) FILTER (NOT is_free) AS BIGINT) AS retained FROM ob GROUP BY 1)
SELECT printf('%12d %12d %8d  %s', retained, exclusive, n, type) AS line FROM t ORDER BY retained DESC, type LIMIT 20""")
def census_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = _objects(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("exclusive"), F.sum(F.when(~F.col("is_free"), F.col("size"))).alias("retained"))
    return files.census_report(census, 20)


@query("S16_gcinfo_import", f"WITH {EV} SELECT seq AS id, CAST(k % 3 AS INTEGER) AS generation, CAST(seq * 1000 AS DOUBLE) AS start_ms, CAST(k AS DOUBLE) AS duration_ms, k * 1000000 AS gen0_size, k AS loh_size, CAST(0 AS BIGINT) AS poh_size, CAST(seq * 1000 + k AS DOUBLE) AS end_ms FROM ev WHERE kind = 'signup'")
def gcinfo_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections are written as an XML export with thousands commas and read back."""
    gcs = tables.trace_events(spark, sf_dir).filter("kind = 'signup'")
    commas = lambda e: F.format_number(F.expr(e), 0)
    rows = gcs.select(commas("seq").alias("Id"), commas("k % 3").alias("Generation"), commas("seq * 1000").alias("StartMs"), commas("k").alias("DurationMs"), commas("k * 1000000").alias("Gen0Size"), commas("k").alias("LOHSize"))
    path = f"{graph.shared_folder(spark)}/gcinfo-{uuid.uuid4().hex}"
    rows.write.format("xml").option("rowTag", "GCEvent").option("rootTag", "Log").save(path)
    return files.read_gcinfo(spark, path)


@query("S19_tick_sidecars", f"""WITH {EV}, tk AS (
  SELECT tid, seq // 5000 AS part, row_number() OVER (PARTITION BY tid, seq // 5000 ORDER BY seq) - 1 AS place, CAST(round_even((us % 86400000000) / 1000.0, 0) AS BIGINT) AS ms, CAST(floor(value * 1000) AS BIGINT) - 20000 AS bytes FROM ev
) SELECT tid, part, place, ms, bytes FROM tk""")
def tick_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thread's events as sidecars of binary records, one for 5,000 numbers, read back in their order."""
    ev = tables.trace_events(spark, sf_dir)
    record = files.encode_tick(F.expr("us % 86400000000") / F.lit(1000.0), F.floor(F.col("value") * 1000) - 20_000)
    ticks = ev.select("tid", F.expr("seq div 5000").alias("part"), "seq", record.alias("record"))
    each = F.array_sort(F.collect_list(F.struct("seq", F.hex("record").alias("h"))))
    sidecars = ticks.groupBy("tid", "part").agg(F.unhex(F.array_join(F.transform(each, lambda r: r["h"]), "")).alias("content"))
    return files.decode_ticks(sidecars)


#: Collections, allocations and methods of 50 processes whose collections have 8 numbers in turn.
_METRICS = f"""{EV}, rw AS (SELECT seq, kind, k, tid % 50 AS p, k % 8 AS g FROM ev),
nm AS (SELECT ['gen_0_min_size', 'loh_size', 'gen_0_size', 'gen_1_size', 'gen_2_size', 'pause_time_end_relative_msec', 'pause_time_start_relative_msec', 'pause_time_msec', 'heap_size',
    'total_promoted', 'loh_promoted', 'gen_0_promoted', 'gen_1_promoted', 'gen_2_promoted'] AS c,
  ['size_before', 'size_after', 'obj_space_before', 'free_list_space_before', 'free_list_space_after', 'free_obj_size_before', 'free_obj_size_after', 'obj_size_after', 'fragmentation',
    'in', 'out', 'new_allocation_size', 'survival_rate', 'pinned_survival', 'non_pinned_survival'] AS h),
sm AS (
  SELECT 'gc_alloc' AS metric, concat('process_id="', p, '",process="app\\\\', p, '",heap_index="', k % 2, '",kind="', CASE WHEN seq % 2 = 0 THEN 'small' ELSE 'large' END, '",type_name="T\\"', k % 5, '\\""') AS labels, seq, seq * 10.0 AS v FROM rw WHERE kind = 'purchase'
  UNION ALL SELECT 'jit_event', concat('process_id="', p, '",process="app\\\\', p, '",is_tiered_up="', CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END, '",has_loaded="loaded",method_id="', k % 6, '",tier="', k % 2, '",method_name="M', k % 6, '"'), seq, seq + 0.5 FROM rw WHERE kind = 'click'
  UNION ALL SELECT 'gc_collection_info', concat('process_id="', p, '",process="app\\\\', p, '",gc_id="', g, '",generation="', k % 3, '",kind="any",reason="Induced",type="', CASE WHEN k % 2 = 0 THEN 'Background' ELSE 'Blocking' END, '",num_heaps="2"'), seq, seq + 7 * 0.25 FROM rw WHERE kind = 'error'
  UNION ALL SELECT concat('gc_collection_', c[i]), concat('process_id="', p, '",gc_id="', g, '"'), seq, seq + (i - 1) * 0.25 FROM rw, nm, range(1, 15) r(i) WHERE kind = 'error'
  UNION ALL SELECT concat('gc_collection_heaps_', h[i]), concat('process_id="', p, '",gc_id="', g, '",heap_index="', seq % 2, '",generation="', k % 4, '"'), seq, seq * 2 + (i - 1) * 0.125 FROM rw, nm, range(1, 16) r(i) WHERE kind = 'error'
), lt AS (
  SELECT metric, labels, CAST(arg_max(v, seq) AS DOUBLE) AS v FROM sm GROUP BY 1, 2
  UNION ALL SELECT 'gc_collection_count', concat('process_id="', p, '",process="app\\\\', p, '"'), CAST(count(*) AS DOUBLE) FROM rw WHERE kind = 'error' GROUP BY p
)"""


@query("K7_metrics", f"""WITH {_METRICS} SELECT metric, concat('live_', metric, '{{', labels, '}} ', CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END) AS line FROM lt""")
def live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 33 metrics after the last event: errors are collections, purchases allocations and clicks methods."""
    ev = tables.trace_events(spark, sf_dir).withColumn("p", F.col("tid") % 50)
    of = lambda kind: ev.filter(F.col("kind") == kind).select("seq", "k", F.col("p").alias("process_id"), F.concat(F.lit("app\\"), "p").alias("process"))
    either = lambda e, yes, no: F.when(F.expr(e), yes).otherwise(no)
    alloc = of("purchase").withColumns({"heap_index": F.col("k") % 2, "kind": either("seq % 2 = 0", "small", "large"), "type_name": F.concat(F.lit('T"'), F.col("k") % 5, F.lit('"')), "alloc_size": F.col("seq") * 10})
    method = F.col("k") % 6
    jitted = of("click").withColumns({"is_tiered_up": either("k % 2 = 0", "yes", "no"), "has_loaded": F.lit("loaded"), "method_id": method, "tier": F.col("k") % 2, "method_name": F.concat(F.lit("M"), method), "load_time": F.col("seq") + 0.5})
    gcs = of("error").withColumn("gc_id", F.col("k") % 8)
    info = {"generation": F.col("k") % 3, "kind": F.lit("any"), "reason": F.lit("Induced"), "type": either("k % 2 = 0", "Background", "Blocking"), "num_heaps": F.lit(2)}
    whole = gcs.withColumns(info | {v: F.col("seq") + i * 0.25 for i, v in enumerate(metrics.COLLECTION_VALUES)})
    heaps = gcs.withColumns({"heap_index": F.col("seq") % 2, "generation": F.col("k") % 4} | {v: F.col("seq") * 2 + i * 0.125 for i, v in enumerate(metrics.HEAP_VALUES)})
    parts = [metrics.samples(rows, table) for rows, table in ((alloc, metrics.ALLOCATION), (jitted, metrics.METHOD), (whole, metrics.COLLECTION), (heaps, metrics.HEAP))]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return metrics.exposition(metrics.latest(together), "live_")
