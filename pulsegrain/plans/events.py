"""Queries over the driver's events, seen as a runtime trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import buckets, classify, rank, temporal
from ..sources import tables
from .registry import ALLOC, CON, EV, EXC, query


def contentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits: a click starts one, the user's next event of clicks and purchases ends it."""
    ev = tables.trace_events(spark, sf_dir)
    paired = temporal.pair_start_stop(ev, ["tid"], "seq", F.col("kind") == "click", F.col("kind") == "purchase", ["rel_ms", "seq", "value", "k"])
    return paired.select("tid", F.col("start_rel_ms").alias("start_ms"), F.col("stop_rel_ms").alias("stop_ms"), (F.col("stop_value") * 1000).alias("duration_ms"), F.col("stop_seq").alias("seq"), "start_seq", (F.col("stop_k") % 7).alias("lock_id"), (F.col("stop_k") % 5).alias("owner"), (F.col("stop_k") % 11).alias("stack_index"))


@query("A1_event_overview", f"WITH {EV} SELECT kind, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ev), 6) AS percent, arg_min(tid, seq) AS first_tid FROM ev GROUP BY kind")
def event_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    counts = ev.groupBy("kind").agg(F.count("*").alias("n"), F.min_by("tid", "seq").alias("first_tid"))
    # a row for each kind is left, so the window over all of them is small
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6)).orderBy(F.desc("n"), "kind")


@query("A2_capture_duration", f"WITH {EV} SELECT min(us) AS first_us, max(us) AS last_us, CAST((max(us) - min(us)) / 1000.0 AS DOUBLE) AS duration_ms FROM ev")
def capture_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    return ev.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), ((F.max("us") - F.min("us")) / 1000.0).alias("duration_ms"))


@query("P1_provider_filter", f"WITH {EV} SELECT seq, tid, kind FROM ev WHERE kind IN ('error', 'signup') AND tid < 50")
def provider_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trace_events(spark, sf_dir).filter(F.col("kind").isin("error", "signup") & (F.col("tid") < 50)).select("seq", "tid", "kind")


@query("P2_relative_time", "SELECT event_id AS seq, CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000.0 AS DOUBLE) AS rel_ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS wall FROM events")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    return ev.select("seq", "rel_ms", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("wall"))


@query("P6_sample_types", f"WITH {EV} SELECT CASE k % 5 WHEN 0 THEN 'Error' WHEN 1 THEN 'External' WHEN 2 THEN 'Managed' ELSE 'Unknown' END AS sample_type, count(*) AS n FROM ev WHERE kind IN ('view', 'click') GROUP BY 1")
def sample_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir).filter(F.col("kind").isin("view", "click"))
    kind = F.col("k") % 5
    named = classify.first_match([(kind == 0, "Error"), (kind == 1, "External"), (kind == 2, "Managed")], "Unknown")
    return ev.groupBy(named.alias("sample_type")).agg(F.count("*").alias("n"))


@query("P13_first_other_frame", "SELECT s_suppkey, coalesce(list_filter(f, lambda x: x NOT LIKE 'A%')[1], f[1], '<no stack captured>') AS site FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN [] ELSE [n_name, r_name] END AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
def first_other_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (tables.read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    place = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    named = s.join(F.broadcast(place), s.s_nationkey == place.n_nationkey)
    frames = F.when(F.col("s_suppkey") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("n_name", "r_name"))
    return named.withColumn("f", frames).select("s_suppkey", classify.first_other_frame(F.col("f"), lambda x: x.startswith("A")).alias("site"))


@query("P17_json_and_hex", f"WITH {EV} SELECT seq, k, upper(to_hex(k + 255)) AS hex FROM ev")
def json_and_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trace_events(spark, sf_dir).select("seq", "k", F.hex(F.col("k") + 255).alias("hex"))


@query("P18_tidy_names", f"WITH {EV} SELECT CASE WHEN nm LIKE '<unresolved%' THEN '<unresolved>' ELSE nm END AS name, count(*) AS n FROM (SELECT CASE WHEN k % 4 = 0 THEN '<unknown>' WHEN k % 4 = 1 THEN concat('<unresolved 0x', k, '>') ELSE kind END AS nm FROM ev) GROUP BY 1")
def tidy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("k") % 4 == 0, F.lit("")).when(F.col("k") % 4 == 1, F.concat(F.lit("<unresolved 0x"), "k", F.lit(">"))).otherwise(F.col("kind"))
    return tables.trace_events(spark, sf_dir).groupBy(classify.tidy_name(raw).alias("name")).agg(F.count("*").alias("n"))


@query("P19_module_of_frame", "SELECT s_suppkey, concat(s_name, '+0x', upper(to_hex(s_suppkey))) AS frame, s_name AS module FROM supplier")
def module_of_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.read(spark, sf_dir, "supplier").withColumn("frame", F.concat("s_name", F.lit("+0x"), F.hex("s_suppkey")))
    return s.select("s_suppkey", "frame", F.regexp_extract("frame", r"^(.+)\+", 1).alias("module"))


@query("P21_severity", f"WITH {EV} SELECT seq, CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'severe' WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'medium' WHEN value > 10 THEN 'low' ELSE 'none' END AS severity FROM ev")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trace_events(spark, sf_dir).select("seq", classify.pause_severity(F.col("value")).alias("severity"))


@query("P22_zoom", f"WITH {EV} SELECT count(*) FILTER (rel_ms >= 1e8 AND rel_ms <= 5e8) AS closed, count(*) FILTER (rel_ms >= 1e8 AND rel_ms < 5e8) AS half_open, count(*) FILTER (NOT (rel_ms + value * 1000 <= 1e8 OR rel_ms >= 5e8)) AS overlapping FROM ev")
def zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, end = F.col("rel_ms"), F.col("rel_ms") + F.col("value") * 1000
    return tables.trace_events(spark, sf_dir).agg(
        F.count_if((t >= 1e8) & (t <= 5e8)).alias("closed"), F.count_if((t >= 1e8) & (t < 5e8)).alias("half_open"), F.count_if(~((end <= 1e8) | (t >= 5e8))).alias("overlapping")
    )


@query("P23_hide_rows", f"WITH {EV}, v AS (SELECT * FROM ev WHERE kind NOT IN ('view', 'signup')) SELECT kind, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM v), 6) AS percent FROM v GROUP BY kind")
def hide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = spark.createDataFrame([("view",), ("signup",)], "kind string")
    seen = tables.trace_events(spark, sf_dir).join(F.broadcast(hidden), "kind", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))
    return seen.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


@query("P24_text_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_type), lower('Promo'))")
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "part").filter(F.lower("p_type").contains("Promo".lower())).select("p_partkey", "p_name")


@query("A3_allocation_by_type", f"""WITH {ALLOC}, s AS (SELECT 'all' AS scope, * FROM al UNION ALL SELECT 'large' AS scope, * FROM al WHERE size_class = 1), g AS (
  SELECT scope, type_name, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS ticks, count(*) FILTER (size_class = 0) AS small, count(*) FILTER (size_class = 1) AS large, count(*) FILTER (size_class = 2) AS pinned FROM s GROUP BY ALL
) SELECT scope, type_name, bytes, ticks, small, large, pinned FROM g QUALIFY row_number() OVER (PARTITION BY scope ORDER BY bytes DESC, type_name) <= 10""")
def allocation_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = tables.allocations(tables.trace_events(spark, sf_dir))
    scopes = F.when(F.col("size_class") == 1, F.array(F.lit("all"), F.lit("large"))).otherwise(F.array(F.lit("all")))
    sums = ticks.withColumn("scope", F.explode(scopes)).groupBy("scope", "type_name").agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("ticks"), *[F.count_if(F.col("size_class") == k).alias(n) for k, n in enumerate(("small", "large", "pinned"))]
    )
    return rank.per_group(sums, ["scope"], [F.desc("bytes"), F.col("type_name")], 10).drop("rank")


@query("A4_allocation_timeline", f"""WITH {ALLOC}, t AS (SELECT type_name FROM al GROUP BY 1 ORDER BY sum(bytes) DESC, type_name LIMIT 8), b AS (
  SELECT CAST(floor(rel_ms / 86400000) AS INTEGER) AS bucket, CASE WHEN type_name IN (SELECT type_name FROM t) THEN type_name ELSE 'Other' END AS series, bytes FROM al
), g AS (SELECT CAST(x AS INTEGER) AS bucket FROM range((SELECT max(bucket) + 1 FROM b)) r(x)), n AS (SELECT DISTINCT series FROM b)
SELECT g.bucket, n.series, CAST(coalesce(sum(b.bytes), 0) AS BIGINT) AS bytes FROM g CROSS JOIN n LEFT JOIN b ON b.bucket = g.bucket AND b.series = n.series GROUP BY ALL""")
def allocation_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = tables.allocations(tables.trace_events(spark, sf_dir))
    sums = buckets.top_and_other(ticks, "type_name", "bytes", 8).groupBy(F.floor(F.col("rel_ms") / 86_400_000).cast("int").alias("bucket"), "series").agg(F.sum("bytes").alias("bytes"))
    # nine series and a bucket for each day: a chart, not a table that grows with the trace
    last = sums.agg(F.max("bucket")).first()[0]
    dense = buckets.grid(spark, 0 if last is None else last + 1).withColumn("__one", F.lit(1)).join(F.broadcast(sums.select("series").distinct().withColumn("__one", F.lit(1))), "__one").drop("__one")
    return dense.join(sums, ["bucket", "series"], "left").fillna({"bytes": 0})


@query("A5_exceptions_by_type", f"WITH {EXC} SELECT type_name, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ex), 6) AS percent, arg_min(message, seq) AS first_message FROM ex GROUP BY 1 ORDER BY n DESC, type_name LIMIT 50")
def exceptions_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = tables.exceptions(tables.trace_events(spark, sf_dir))
    types = ex.groupBy("type_name").agg(F.count("*").alias("n"), F.min_by("message", "seq").alias("first_message"))
    shares = types.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))
    return rank.top(shares, [F.desc("n"), F.col("type_name")], 50)


@query("A6_exception_histogram", f"""WITH {EXC}, s AS (SELECT min(rel_ms) AS lo, max(rel_ms) AS hi, least(count(*), 100) AS n FROM ex), b AS (
  SELECT CAST(least(floor((rel_ms - lo) / ((hi - lo) / n)), n - 1) AS INTEGER) AS bucket FROM ex, s
) SELECT CAST(g AS INTEGER) AS bucket, count(b.bucket) AS n FROM range((SELECT n FROM s)) r(g) LEFT JOIN b ON b.bucket = g GROUP BY 1""")
def exception_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.histogram(tables.exceptions(tables.trace_events(spark, sf_dir)), "rel_ms", {"n": F.count("*")})


@query("A7_contention_by_site", f"WITH {CON} SELECT stack_index, count(*) AS n, round(sum(duration_ms), 3) AS total_ms, round(avg(duration_ms), 6) AS avg_ms, round(sum(duration_ms) * 100.0 / (SELECT sum(duration_ms) FROM co), 6) AS percent FROM co GROUP BY 1 ORDER BY sum(duration_ms) DESC, stack_index LIMIT 50")
def contention_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = contentions(spark, sf_dir).groupBy("stack_index").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"))
    shares = sites.withColumn("percent", F.round(F.col("total") * 100.0 / F.sum("total").over(Window.partitionBy()), 6))
    return rank.top(shares, [F.desc("total"), F.col("stack_index")], 50).withColumn("total_ms", F.round("total", 3)).drop("total")


@query("A8_lock_stats", f"WITH {CON} SELECT lock_id, count(*) AS n, round(sum(duration_ms), 3) AS total_ms, max(duration_ms) AS max_ms, count(DISTINCT tid) AS waiters, count(DISTINCT CASE WHEN owner <> 0 THEN owner END) AS owners FROM co WHERE lock_id <> 0 GROUP BY 1")
def lock_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = contentions(spark, sf_dir).filter("lock_id <> 0")
    return known.groupBy("lock_id").agg(
        F.count("*").alias("n"), F.round(F.sum("duration_ms"), 3).alias("total_ms"), F.max("duration_ms").alias("max_ms"), F.count_distinct("tid").alias("waiters"), F.count_distinct(F.when(F.col("owner") != 0, F.col("owner"))).alias("owners")
    )


@query("A9_p99_wait", f"WITH {CON}, r AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS n FROM co) SELECT duration_ms AS p99_ms FROM r WHERE i = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)")
def p99_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = rank.exact_quantile(contentions(spark, sf_dir), "duration_ms", 0.99)
    return spark.createDataFrame([] if value is None else [(value,)], "p99_ms double")


@query("A10_longest_waits", f"WITH {CON} SELECT seq, tid, lock_id, duration_ms FROM co ORDER BY duration_ms DESC, seq LIMIT 25")
def longest_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top(contentions(spark, sf_dir), [F.desc("duration_ms"), F.col("seq")], 25).select("seq", "tid", "lock_id", "duration_ms")


@query("A11_lock_names", f"WITH {CON} SELECT lock_id, arg_max(stack_index, w) AS heaviest_stack FROM (SELECT lock_id, stack_index, [sum(duration_ms), -stack_index] AS w FROM co WHERE lock_id <> 0 GROUP BY 1, 2) GROUP BY 1")
def lock_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = contentions(spark, sf_dir).filter("lock_id <> 0").groupBy("lock_id", "stack_index").agg(F.sum("duration_ms").alias("w"))
    return weights.groupBy("lock_id").agg(F.max_by("stack_index", F.struct("w", -F.col("stack_index"))).alias("heaviest_stack"))


@query("A13_cpu_timeline", f"""WITH {EV}, sa AS (SELECT * FROM ev WHERE kind = 'view'), s AS (SELECT min(rel_ms) AS lo, max(rel_ms) AS hi FROM sa), b AS (
  SELECT CAST(least(floor((rel_ms - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bucket, tid FROM sa, s
) SELECT CAST(g AS INTEGER) AS bucket, count(b.tid) AS samples, count(b.tid) FILTER (b.tid % 2 = 0) AS even_samples FROM range(100) r(g) LEFT JOIN b ON b.bucket = g GROUP BY 1""")
def cpu_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.trace_events(spark, sf_dir).filter("kind = 'view'")
    return buckets.histogram(samples, "rel_ms", {"samples": F.count("*"), "even_samples": F.count_if(F.col("tid") % 2 == 0)}, fixed=100)


@query("A18_pool_series", f"""WITH {EV}, s AS (SELECT min(rel_ms) AS lo, max(rel_ms) AS hi FROM ev), b AS (
  SELECT CAST(least(floor((rel_ms - lo) / ((hi - lo) / 200)), 199) AS INTEGER) AS bucket, k FROM ev, s
) SELECT CAST(g AS INTEGER) AS bucket, coalesce(min(k), 0) AS low, coalesce(max(k), 0) AS high, coalesce(round(avg(k), 6), 0) AS mean, count(k) AS n FROM range(200) r(g) LEFT JOIN b ON b.bucket = g GROUP BY 1""")
def pool_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    return buckets.histogram(ev, "rel_ms", {"low": F.min("k"), "high": F.max("k"), "mean": F.round(F.avg("k"), 6), "n": F.count("k")}, fixed=200)


@query("A19_adjustment_reasons", f"WITH {EV} SELECT k % 9 AS reason, count(*) AS n, k % 9 IN (6, 8) AS stall_driven FROM ev WHERE kind = 'signup' GROUP BY ALL")
def adjustment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = tables.trace_events(spark, sf_dir).filter("kind = 'signup'").groupBy((F.col("k") % 9).alias("reason")).agg(F.count("*").alias("n"))
    return reasons.withColumn("stall_driven", F.col("reason").isin(6, 8))


@query("A22_time_breakdown", f"""WITH {CON}, i AS (SELECT start_ms AS s, start_ms + duration_ms AS e FROM co WHERE duration_ms > 0), m AS (
  SELECT *, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (ORDER BY s, e) AS isl FROM m), u AS (SELECT sum(e - s) AS covered FROM (SELECT min(s) AS s, max(e) AS e FROM g GROUP BY isl)),
d AS (SELECT max(rel_ms) - min(rel_ms) AS d FROM ev)
SELECT round(covered * 100 / d, 6) AS contention_percent, round((SELECT sum(duration_ms) FROM co WHERE duration_ms > 0) / d, 6) AS avg_blocked, round((SELECT count(*) FILTER (kind = 'view') * 100.0 / count(*) FROM ev), 6) AS idle_percent FROM u, d""")
def time_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    waits = contentions(spark, sf_dir).select("start_ms", (F.col("start_ms") + F.col("duration_ms")).alias("end_ms"), "duration_ms")
    whole = ev.agg((F.max("rel_ms") - F.min("rel_ms")).alias("d"), F.round(F.count_if(F.col("kind") == "view") * 100.0 / F.count("*"), 6).alias("idle_percent")).withColumn("one", F.lit(1))
    covered = temporal.union_length(waits.withColumn("one", F.lit(1)), ["one"], "start_ms", "end_ms", cell=3_600_000.0)
    blocked = waits.filter("duration_ms > 0").agg(F.sum("duration_ms").alias("sum_ms")).withColumn("one", F.lit(1))
    # three tables of one row
    row = whole.join(F.broadcast(covered), "one").join(F.broadcast(blocked), "one")
    return row.select(F.round(F.col("covered") * 100 / F.col("d"), 6).alias("contention_percent"), F.round(F.col("sum_ms") / F.col("d"), 6).alias("avg_blocked"), "idle_percent")


@query("A23_gc_generations", f"WITH {EV} SELECT k % 3 AS generation, count(*) AS n, round(sum(value), 6) AS total_pause, max(value) AS max_pause, CAST(sum(k) AS BIGINT) AS promoted, arg_max(k, seq) AS final_size FROM ev WHERE kind = 'signup' GROUP BY 1")
def gc_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    gcs = tables.trace_events(spark, sf_dir).filter("kind = 'signup'")
    return gcs.groupBy((F.col("k") % 3).alias("generation")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total_pause"), F.max("value").alias("max_pause"), F.sum("k").alias("promoted"), F.max_by("k", "seq").alias("final_size"))


@query("A25_pause_stats", f"WITH {EV}, r AS (SELECT k % 3 AS generation, value, row_number() OVER (PARTITION BY k % 3 ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY k % 3) AS n FROM ev WHERE kind = 'signup') SELECT generation, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, max(CASE WHEN i = n // 2 THEN value END) AS median, max(value) AS largest, min(value) AS smallest FROM r GROUP BY 1")
def pause_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    gcs = tables.trace_events(spark, sf_dir).filter("kind = 'signup'").withColumn("generation", F.col("k") % 3)
    sums = gcs.groupBy("generation").agg(F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("largest"), F.min("value").alias("smallest"))
    return sums.join(rank.grouped_quantiles(gcs, ["generation"], "value", {"median": F.floor(F.col("n") / 2)}, F.col("seq")), "generation").drop("n")


@query("A30_jit_buckets", f"WITH {EV} SELECT CAST(floor(rel_ms / 3600000) AS BIGINT) AS bucket, k % 2 AS tier, count(*) AS n, round(sum(value), 6) AS total FROM ev WHERE kind = 'view' GROUP BY ALL")
def jit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = tables.trace_events(spark, sf_dir).filter("kind = 'view'")
    # the width follows the length of the capture, from 100 ms to an hour
    low, high, _ = buckets.span(loads, "rel_ms")
    width = next((w for w in (100, 1000, 10_000, 60_000, 600_000) if (high - low) / w <= 200), 3_600_000)
    return loads.groupBy(F.floor(F.col("rel_ms") / width).alias("bucket"), (F.col("k") % 2).alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("A31_live_alloc_totals", f"WITH {ALLOC} SELECT heap, type_name, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n FROM al GROUP BY ALL")
def live_alloc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.allocations(tables.trace_events(spark, sf_dir)).groupBy("heap", "type_name").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


@query("A32_tick_downsampling", f"""WITH {ALLOC}, s AS (SELECT min(rel_ms) AS lo, max(rel_ms) AS hi FROM al) SELECT CAST(least(floor((rel_ms - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bucket, CAST(sum(bytes) AS BIGINT) AS total FROM al, s GROUP BY 1""")
def tick_downsampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.downsample(tables.allocations(tables.trace_events(spark, sf_dir)), "rel_ms", "bytes", 50).select("bucket", "total")


@query("A33_bytes_between_gcs", f"""WITH {ALLOC}, g AS (SELECT seq AS gc_seq, rel_ms AS gc_ms FROM ev WHERE kind = 'signup'), n AS (SELECT al.bytes, (SELECT min(gc_seq) FROM g WHERE g.gc_ms > al.rel_ms) AS gc_seq FROM al)
SELECT g.gc_seq, CAST(coalesce(sum(n.bytes), 0) AS BIGINT) AS bytes FROM g LEFT JOIN n ON n.gc_seq = g.gc_seq GROUP BY 1""")
def bytes_between_gcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir).filter(F.col("kind").isin("signup", "purchase"))
    # a row for each time of a day; days are ordered in parallel, from their end, so that a running minimum is what comes later
    is_gc = F.col("kind") == "signup"
    day = F.floor(F.col("rel_ms") / 86_400_000).alias("day")
    times = ev.groupBy(day, "rel_ms").agg(F.min(F.when(is_gc, F.col("seq"))).alias("gc"), F.sum(F.when(~is_gc, F.floor(F.col("value") * 1000))).alias("bytes"))
    w = Window.partitionBy("day").orderBy(F.desc("rel_ms")).rowsBetween(Window.unboundedPreceding, -1)
    rows = times.withColumn("in_day", F.min("gc").over(w))
    # a row for each day is left, so the window over all of them is small
    days = ev.filter(is_gc).groupBy(day).agg(F.min("seq").alias("first"))
    known = ev.select(day).distinct().join(days, "day", "left")
    carry = known.select("day", F.min("first").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    ticks = rows.filter("bytes IS NOT NULL").join(F.broadcast(carry), "day", "left").withColumn("gc_seq", F.least("in_day", "later"))
    sums = ticks.groupBy("gc_seq").agg(F.sum("bytes").alias("bytes"))
    return ev.filter(is_gc).select(F.col("seq").alias("gc_seq")).join(sums, "gc_seq", "left").fillna({"bytes": 0})


@query("A41_roster", f"WITH {CON} SELECT id, role, count(*) AS n FROM (SELECT tid AS id, 'waiter' AS role FROM co UNION ALL SELECT owner, 'owner' FROM co WHERE owner <> 0) GROUP BY ALL")
def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = contentions(spark, sf_dir)
    both = F.array(F.struct(F.col("tid").alias("id"), F.lit("waiter").alias("role")), F.struct(F.col("owner").alias("id"), F.lit("owner").alias("role")))
    return con.select(F.inline(both)).filter("NOT (role = 'owner' AND id = 0)").groupBy("id", "role").agg(F.count("*").alias("n"))


@query("W1_interval_union", f"""WITH {EV}, i AS (SELECT kind, rel_ms AS s, rel_ms + value * 1000 AS e FROM ev WHERE value > 0), m AS (
  SELECT *, max(e) OVER (PARTITION BY kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY s, e) AS isl FROM m)
SELECT kind, round(sum(e - s), 3) AS covered FROM (SELECT kind, isl, min(s) AS s, max(e) AS e FROM g GROUP BY ALL) GROUP BY kind""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir).withColumn("end_ms", F.col("rel_ms") + F.col("value") * 1000)
    return temporal.union_length(ev, ["kind"], "rel_ms", "end_ms", cell=3_600_000.0).select("kind", F.round("covered", 3).alias("covered"))


@query("W2_idle_runs", f"""WITH {EV}, a AS (SELECT *, kind IN ('view', 'click') AS idle FROM ev), b AS (SELECT *, CASE WHEN lag(idle) OVER w IS DISTINCT FROM idle THEN 1 ELSE 0 END AS chg FROM a WINDOW w AS (PARTITION BY tid ORDER BY seq)), c AS (SELECT *, sum(chg) OVER (PARTITION BY tid ORDER BY seq) AS run FROM b),
d AS (SELECT tid, idle, run, max(rel_ms) - min(rel_ms) AS len FROM c GROUP BY ALL) SELECT tid, round(coalesce(max(CASE WHEN idle THEN len END), 0), 3) AS longest_idle_ms, count(*) FILTER (NOT idle AND run > 1) AS wakes FROM d GROUP BY 1""")
def idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = temporal.islands(tables.trace_events(spark, sf_dir), ["tid"], "seq", F.col("kind").isin("view", "click"))
    runs = ev.groupBy("tid", "run", "state").agg((F.max("rel_ms") - F.min("rel_ms")).alias("len"))
    return runs.groupBy("tid").agg(F.round(F.coalesce(F.max(F.when(F.col("state"), F.col("len"))), F.lit(0.0)), 3).alias("longest_idle_ms"), F.count_if(~F.col("state") & (F.col("run") > 1)).alias("wakes"))


@query("W3_delta", f"WITH {EV} SELECT seq, k - coalesce(lag(k) OVER (PARTITION BY tid ORDER BY seq), k) AS delta FROM ev WHERE kind = 'signup'")
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("tid").orderBy("seq")
    return tables.trace_events(spark, sf_dir).filter("kind = 'signup'").select("seq", (F.col("k") - F.coalesce(F.lag("k").over(w), F.col("k"))).alias("delta"))


@query("W5_stable_order", f"WITH {EV} SELECT seq, CAST(row_number() OVER (PARTITION BY tid ORDER BY floor(rel_ms / 1000), seq) AS INTEGER) AS place FROM ev")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("tid").orderBy(F.floor(F.col("rel_ms") / 1000), "seq")
    return tables.trace_events(spark, sf_dir).select("seq", F.row_number().over(w).alias("place"))


@query("W7_segment_budget", f"WITH {CON}, r AS (SELECT lock_id, rank() OVER (ORDER BY t DESC, lock_id) AS lr FROM (SELECT lock_id, sum(duration_ms) AS t FROM co WHERE lock_id <> 0 GROUP BY 1)) SELECT co.seq, co.lock_id FROM co JOIN r USING (lock_id) ORDER BY lr, duration_ms DESC, seq LIMIT 60")
def segment_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = contentions(spark, sf_dir).filter("lock_id <> 0")
    totals = con.groupBy("lock_id").agg(F.sum("duration_ms").alias("lock_total"))
    return con.join(totals, "lock_id").orderBy(F.desc("lock_total"), "lock_id", F.desc("duration_ms"), "seq").limit(60).select("seq", "lock_id")


@query("W8_first_by_stream_order", f"WITH {EV} SELECT seq, tid FROM ev WHERE kind = 'signup' ORDER BY seq LIMIT 500")
def first_by_stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trace_events(spark, sf_dir).filter("kind = 'signup'").orderBy("seq").limit(500).select("seq", "tid")


@query("J6_start_stop_pairs", f"WITH {CON} SELECT tid, start_seq, seq, start_ms, stop_ms, duration_ms FROM co")
def start_stop_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentions(spark, sf_dir).select("tid", "start_seq", "seq", "start_ms", "stop_ms", "duration_ms")


@query("J8_asof_within_tolerance", f"""WITH {EV}, ad AS (SELECT seq AS adj, rel_ms AS at_ms FROM ev WHERE kind = 'signup'), sa AS (SELECT seq, rel_ms, tid FROM ev WHERE kind = 'view')
SELECT adj, tid, arg_min(seq, [at_ms - rel_ms, CAST(seq AS DOUBLE)]) AS seq FROM ad JOIN sa ON at_ms - rel_ms >= 0 AND at_ms - rel_ms <= 7200000 GROUP BY ALL""")
def asof_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    adj = ev.filter("kind = 'signup'").select(F.col("seq").alias("adj"), F.col("rel_ms").alias("at"))
    met = temporal.asof_backward(adj, ev.filter("kind = 'view'"), "at", "rel_ms", 7_200_000.0, ["tid"], "adj", "seq", ["seq"])
    return met.select("adj", "tid", "seq")


@query("J9_nearest_preceding", f"WITH {EV}, p AS (SELECT * FROM ev WHERE kind = 'purchase'), a AS (SELECT seq AS adj, rel_ms AS at, tid FROM ev WHERE kind = 'signup') SELECT p.seq, CASE WHEN p.rel_ms - a.at <= 86400000 THEN a.adj END AS adj FROM p ASOF LEFT JOIN a ON p.tid = a.tid AND p.rel_ms >= a.at")
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir).filter(F.col("kind").isin("signup", "purchase"))
    mark = temporal.last_before(ev, ["tid"], ["rel_ms", "seq"], F.col("kind") == "signup", F.struct("seq", "rel_ms"))
    seen = ev.withColumn("mark", mark).filter("kind = 'purchase'")
    return seen.select("seq", F.when(F.col("rel_ms") - F.col("mark.rel_ms") <= 86_400_000, F.col("mark.seq")).alias("adj"))


@query("J10_stall_window_samples", f"WITH {EV}, t AS (SELECT rel_ms AS at_ms FROM ev WHERE kind = 'error' AND k < 30) SELECT seq, tid FROM ev WHERE kind = 'view' AND EXISTS (SELECT 1 FROM t WHERE ev.rel_ms >= at_ms - 600000 AND ev.rel_ms <= at_ms)")
def stall_window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    stalls = ev.filter("kind = 'error' AND k < 30").select(F.col("rel_ms").alias("at_ms"))
    return temporal.within_windows(ev.filter("kind = 'view'"), stalls, "rel_ms", "at_ms", 600_000.0).select("seq", "tid")


@query("J14_thread_process", f"WITH {EV} SELECT c_nationkey AS pid, count(*) AS n FROM ev JOIN customer ON tid = c_custkey GROUP BY 1")
def thread_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.trace_events(spark, sf_dir).groupBy("tid").agg(F.count("*").alias("n"))
    threads = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tid"), F.col("c_nationkey").alias("pid"))
    return counts.join(threads, "tid").groupBy("pid").agg(F.sum("n").alias("n"))


@query("J18_tier_up_sets", f"WITH {EV}, m AS (SELECT k, bool_or(kind = 'click') AS r2r, bool_or(kind = 'view' AND tid % 2 = 0) AS t0, bool_or(kind = 'view' AND tid % 2 = 1) AS t1 FROM ev GROUP BY 1) SELECT count(*) FILTER (r2r AND (t0 OR t1)) AS rejitted, count(*) FILTER (r2r AND NOT t0 AND NOT t1) AS only_r2r, count(*) FILTER (t0 AND t1) AS tiered_up FROM m")
def tier_up_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir)
    view, odd = F.col("kind") == "view", F.col("tid") % 2 == 1
    methods = ev.groupBy("k").agg(F.bool_or(F.col("kind") == "click").alias("r2r"), F.bool_or(view & ~odd).alias("t0"), F.bool_or(view & odd).alias("t1"))
    return methods.agg(F.count_if(F.expr("r2r AND (t0 OR t1)")).alias("rejitted"), F.count_if(F.expr("r2r AND NOT t0 AND NOT t1")).alias("only_r2r"), F.count_if(F.expr("t0 AND t1")).alias("tiered_up"))


DIFF_SIDE = "CASE WHEN rel_ms < (SELECT max(rel_ms) / 2 FROM ev) THEN 'a' ELSE 'b' END"


@query("J11_capture_diff", f"""WITH {EV}, m AS (SELECT {DIFF_SIDE} AS side, concat(kind, ':', k % 30) AS name, value FROM ev WHERE NOT (kind = 'view' AND k % 30 < 3 AND rel_ms < (SELECT max(rel_ms) / 2 FROM ev))), d AS (SELECT side, greatest(max(rel_ms) - min(rel_ms), 0) / 1000.0 AS sec FROM (SELECT {DIFF_SIDE} AS side, rel_ms FROM ev) GROUP BY 1),
p AS (SELECT side, name, count(*) AS n, sum(value) AS amount FROM m GROUP BY ALL), a AS (SELECT * FROM p WHERE side = 'a'), b AS (SELECT * FROM p WHERE side = 'b')
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'matched' END AS status, coalesce(b.n, 0) - coalesce(a.n, 0) AS count_change,
  round(coalesce(b.amount, 0) / (SELECT sec FROM d WHERE side = 'b') - coalesce(a.amount, 0) / (SELECT sec FROM d WHERE side = 'a'), 6) AS rate_change,
  CASE WHEN coalesce(a.amount, 0) <> 0 THEN round((coalesce(b.amount, 0) - a.amount) * 100 / a.amount, 6) END AS percent_change
FROM a FULL OUTER JOIN b ON a.name = b.name""")
def capture_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import diff

    ev = tables.trace_events(spark, sf_dir)
    half = ev.agg(F.max("rel_ms") / 2).first()[0]
    sides = ev.withColumn("side", F.when(F.col("rel_ms") < half, "a").otherwise("b"))
    seconds = {r[0]: r[1] for r in sides.groupBy("side").agg((F.max("rel_ms") - F.min("rel_ms")) / 1000.0).collect()}
    named = sides.filter(~((F.col("kind") == "view") & (F.col("k") % 30 < 3) & (F.col("rel_ms") < half)))
    named = named.groupBy("side", F.concat("kind", F.lit(":"), F.col("k") % 30).alias("name")).agg(F.count("*").alias("n"), F.sum("value").alias("amount"))
    return diff.compare(named.filter("side = 'a'"), named.filter("side = 'b'"), seconds.get("a", 0.0), seconds.get("b", 0.0))
