"""Queries that apply the rules about frame names, modules, events and threads.

The driver's tables have no frame names, so keys pick names from FRAMES and stacks from STACKS; the
SQL has the same names with the outcome that each must have, written out by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import event_names
from ..operators import frame_rules, rank, stacks, threads
from ..sources import tables
from .events import contentions
from .registry import CON, EV, query

#: name, category, whether it idles, waits for I/O, and takes a lock.
FRAMES = [
    ("System.GC.Collect", "GarbageCollection", 0, 0, 0),
    ("WKS::gc_heap::mark_phase", "GarbageCollection", 0, 0, 0),
    ("RhpNewFast", "Allocation", 0, 0, 0),
    ("Alloc", "Allocation", 0, 0, 0),
    ("Compiler::fgMorph", "Jit", 0, 0, 0),
    ("SSL_read", "TlsCrypto", 0, 0, 0),
    ("System.Net.Security.SslStream.ReadAsync", "TlsCrypto", 0, 0, 0),
    ("deflate_fast", "Compression", 0, 0, 0),
    ("System.IO.Compression.DeflateStream.Write", "Compression", 0, 0, 0),
    ("System.Net.Sockets.Socket.Receive", "Networking", 0, 1, 0),
    ("SystemNative_Recv", "Networking", 0, 0, 0),
    ("System.Text.Json.JsonSerializer.Write", "Serialization", 0, 0, 0),
    ("System.Threading.Monitor.Wait", "LockingAndSynchronization", 1, 0, 1),
    ("System.Threading.Lock.Enter", "LockingAndSynchronization", 0, 0, 1),
    ("futex_wait", "LockingAndSynchronization", 0, 0, 0),
    ("System.Threading.LowLevelLifoSemaphore.WaitForSignal", "ThreadPoolAndScheduling", 1, 1, 0),
    ("System.Threading.Tasks.Task.Wait", "ThreadPoolAndScheduling", 1, 0, 0),
    ("__schedule", "ThreadPoolAndScheduling", 0, 0, 0),
    ("System.Threading.ThreadPoolWorkQueue.Dispatch", "ThreadPoolAndScheduling", 0, 0, 0),
    ("ucol_strcoll", "Globalization", 0, 0, 0),
    ("System.Globalization.CompareInfo.Compare", "Globalization", 0, 0, 0),
    ("__vdso_clock_gettime", "Kernel", 0, 0, 0),
    ("[vdso]+0x10", "Kernel", 0, 0, 0),
    ("[jit] stub+0x20", "RuntimeGeneratedCode", 0, 0, 0),
    ("libfoo.so+0x1a2b", "Unresolved", 0, 0, 0),
    ("libbar.so+0x77", "Unresolved", 0, 0, 0),
    ("<unresolved 0xFF>", "Unresolved", 0, 0, 0),
    ("System.String.Concat", "ManagedFramework", 0, 0, 0),
    ("Interop+Sys.Read", "ManagedFramework", 1, 1, 0),
    ("System.IO.FileStream.Read", "ManagedFramework", 0, 1, 0),
    ("System.Threading.Thread.Sleep", "ManagedFramework", 1, 0, 0),
    ("System.Threading.SpinLock.Enter", "ManagedFramework", 1, 0, 1),
    ("System.Threading.SemaphoreSlim.Wait", "ManagedFramework", 1, 0, 0),
    ("Shop.Orders.Submit", "ApplicationCode", 0, 0, 0),
    ("Shop.Orders+0", "ApplicationCode", 0, 0, 0),
    ("memcpy", "RuntimeOther", 0, 0, 0),
    ("JIT_WriteBarrier", "RuntimeOther", 0, 0, 0),
    ("plain_symbol", "Uncategorized", 0, 0, 0),
    ("PollGCWorker", "Uncategorized", 1, 0, 0),
    ("", "Uncategorized", 0, 0, 0),
]
#: path and source of modules.
MODULES = [
    ("/usr/share/dotnet/shared/x/libcoreclr.so", "DotnetRuntime"), ("/opt/app/libSystem.Net.Native.so", "DotnetRuntime"), ("/x/dotnet/host/fxr.so", "DotnetRuntime"), ("/opt/app/Shop.dll", "NotFetchable"), ("[vdso]", "NotFetchable"),
    ("/boot/vmlinuz-6.1", "DistributionLibrary"), ("libc.so.6", "DistributionLibrary"), ("/usr/lib64/libfoo.so", "DistributionLibrary"), ("/opt/app/libown.so", "Unknown"), ("", "Unknown"), ("/opt/dir/", "Unknown"),
]
#: frames of a stack, leaf first; whether its leaf waits and is the pool's park, and whether it is a pool worker's or the runtime's.
STACKS = [
    (("System.Threading.LowLevelLifoSemaphore.WaitForSignal", "System.Threading.PortableThreadPool+WorkerThread.WorkerThreadStart"), 1, 1, 1, 0),
    (("System.Threading.WaitHandle.WaitOneNoCheck", "System.Threading.PortableThreadPool+GateThread.GateThreadStart"), 1, 0, 1, 1),
    (("System.Threading.Monitor.Wait", "App.Queue.Take", "App.Worker.Run"), 1, 0, 0, 0),
    (("App.Cache.Get", "App.Worker.Run"), 0, 0, 0, 0),
    (("App.Parser.Read", "System.Threading.ThreadPoolWorkQueue.Dispatch"), 0, 0, 1, 0),
    (("System.Threading.Monitor.Enter", "App.Cache.Get", "System.Threading.ThreadPoolWorkQueue.Dispatch"), 1, 0, 1, 0),
    (("Interop+Sys.Read", "App.Net.Loop"), 1, 0, 0, 0),
]
#: Which stacks the threads 0 .. 7 are seen in, by the sample.
SEEN = [(1, 1, 1, 1), (0, 0, 0, 0), (5, 5, 5, 5), (2, 2, 2, 2), (3, 4, 3, 6), (2, 6, 2, 3), (4, 0, 4, 0), (4, 5, 5, 5)]


def _values(rows: list[tuple]) -> str:
    literal = lambda x: "[" + ", ".join(map(literal, x)) + "]" if isinstance(x, tuple) else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"({n}, {', '.join(map(literal, r))})" for n, r in enumerate(rows))


FR = f"fr AS (SELECT * FROM (VALUES {_values(FRAMES)}) t(i, frame, category, idle, io, lock))"


def _pick(names: list[str], key):
    return F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))


def _part_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.read(spark, sf_dir, "part")
    return part.select("p_partkey", _pick([f[0] for f in FRAMES], F.col("p_partkey")).alias("frame"))


def _ruled(rows: DataFrame, **rules) -> DataFrame:
    """Rules run once for each distinct name."""
    names = rows.select("frame").distinct().withColumns({name: rule(F.col("frame")) for name, rule in rules.items()})
    return rows.join(names, "frame")  # Spark broadcasts the names if they are few


NAMED = ", ".join(f"({i}, '{n}')" for i, n in event_names.RUNTIME_EVENTS.items())


@query("P7_display_name", f"WITH {EV}, nm AS (SELECT * FROM (VALUES {NAMED}) t(i, known)) SELECT seq, coalesce(CASE WHEN k % 2 = 0 THEN kind END, known, concat('EventID ', seq % 310)) AS name FROM ev LEFT JOIN nm ON seq % 310 = i")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.trace_events(spark, sf_dir).withColumns({"provider": F.lit(event_names.RUNTIME), "id": (F.col("seq") % 310).cast("int")})
    return event_names.with_display_name(ev, "provider", "id", F.when(F.col("k") % 2 == 0, F.col("kind"))).select("seq", "name")


#: Names written out by hand, without the table that the query reads them from.
BY_HAND = "(1, 'GC/Start'), (2, 'GC/Stop'), (4, 'GC/HeapStats'), (9, 'GC/SuspendEEStart'), (10, 'GC/AllocationTick'), (50, 'ThreadPoolWorkerThread/Start'), (80, 'Exception/Start'), (81, 'Contention/Start'), (91, 'Contention/Stop'), (143, 'Method/LoadVerbose'), (145, 'Method/JittingStarted')"


@query("P7_names_by_hand", f"WITH {EV} SELECT seq, name FROM ev JOIN (VALUES {BY_HAND}) t(i, name) ON seq % 310 = i")
def names_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [1, 2, 4, 9, 10, 50, 80, 81, 91, 143, 145]
    ev = tables.trace_events(spark, sf_dir).withColumns({"provider": F.lit(event_names.RUNTIME), "id": (F.col("seq") % 310).cast("int")})
    return event_names.with_display_name(ev.filter(F.col("id").isin(ids)), "provider", "id", F.lit(None).cast("string")).select("seq", "name")


@query("P8_category_rules", f"WITH {FR} SELECT p_partkey, frame, category FROM part JOIN fr ON p_partkey % {len(FRAMES)} = i")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(_part_frames(spark, sf_dir), category=frame_rules.cpu_category).select("p_partkey", "frame", "category")


@query("P9_symbol_source", f"SELECT s_suppkey, path, source FROM supplier JOIN (VALUES {_values(MODULES)}) t(i, path, source) ON s_suppkey % {len(MODULES)} = i")
def symbol_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.read(spark, sf_dir, "supplier").withColumn("path", _pick([m[0] for m in MODULES], F.col("s_suppkey")))
    return s.select("s_suppkey", "path", frame_rules.symbol_source(F.col("path")).alias("source"))


@query("P10_idle_leaf", f"WITH {FR} SELECT p_partkey, idle = 1 AS idle FROM part JOIN fr ON p_partkey % {len(FRAMES)} = i")
def idle_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(_part_frames(spark, sf_dir), idle=frame_rules.is_idle).select("p_partkey", "idle")


@query("P11_io_leaves", f"WITH {FR} SELECT p_partkey, io = 1 AS io FROM part JOIN fr ON p_partkey % {len(FRAMES)} = i")
def io_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(_part_frames(spark, sf_dir), io=frame_rules.is_io).select("p_partkey", "io")


@query("P12_frame_markers", f"WITH st AS (SELECT * FROM (VALUES {_values(STACKS)}) t(i, f, wait, park, worker, runtime)), {FR} SELECT s_suppkey, park = 1 AS park, worker = 1 AS worker, runtime = 1 AS runtime, lock = 1 AS lock FROM supplier JOIN st ON s_suppkey % {len(STACKS)} = st.i JOIN fr ON s_suppkey % {len(FRAMES)} = fr.i")
def frame_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.read(spark, sf_dir, "supplier").withColumns({"f": _stack(F.col("s_suppkey") % len(STACKS)), "frame": _pick([f[0] for f in FRAMES], F.col("s_suppkey"))})
    park = frame_rules.any_of(F.col("f")[0], frame_rules.POOL_PARK_PREFIXES)
    return s.select("s_suppkey", park.alias("park"), frame_rules.on_pool_worker(F.col("f")).alias("worker"), frame_rules.of_runtime(F.col("f")).alias("runtime"), frame_rules.is_lock(F.col("frame")).alias("lock"))


def _stack(index):
    return F.element_at(F.array(*[F.array(*map(F.lit, s[0])) for s in STACKS]), (index + 1).cast("int"))


NAMES, LABELS = (f"{[f[k] for f in FRAMES]}" for k in (0, 1))
CPU = f"cs AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN [] ELSE [l_partkey % {len(FRAMES)}, l_suppkey % {len(FRAMES)}, l_linenumber * 7 % {len(FRAMES)}] END AS f, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY 1), cf AS (SELECT f, weight, list_transform(f, lambda x: {NAMES}[x + 1]) AS names, CASE WHEN len(f) = 0 THEN ['Uncategorized'] ELSE list_transform(f, lambda x: {LABELS}[x + 1]) END AS c FROM cs)"


def _cpu_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as stacks of three frames; every fiftieth part has an empty one."""
    names = [f[0] for f in FRAMES]
    line = tables.read(spark, sf_dir, "lineitem")
    frames = F.when(F.col("l_partkey") % 50 == 0, F.array().cast("array<string>")).otherwise(F.array(_pick(names, F.col("l_partkey")), _pick(names, F.col("l_suppkey")), _pick(names, F.col("l_linenumber") * 7)))
    return line.groupBy(frames.alias("frames")).agg(F.sum("l_quantity").alias("weight"))


@query("A14_categories", f"WITH {CPU}, e AS (SELECT c[1] AS leaf, unnest(list_distinct(c)) AS category, weight FROM cf) SELECT category, sum(CASE WHEN category = leaf THEN weight ELSE 0 END) AS self, sum(weight) AS on_stack FROM e GROUP BY 1")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories are looked up for each distinct frame, then counted over stacks."""
    return stacks.by_category(_cpu_stacks(spark, sf_dir), "frames", "weight", lambda f: frame_rules.cpu_category(f))


@query("A14_top_methods", f"WITH {CPU}, l AS (SELECT c[1] AS category, names[1] AS frame, sum(weight) AS self FROM cf WHERE len(f) > 0 GROUP BY ALL) SELECT category, frame, self, CAST(row_number() OVER (PARTITION BY category ORDER BY self DESC, frame) AS INTEGER) AS rank FROM l QUALIFY rank <= 8")
def category_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight heaviest leaves of each category."""
    leaves = _cpu_stacks(spark, sf_dir).filter(F.size("frames") > 0).groupBy(F.col("frames")[0].alias("frame")).agg(F.sum("weight").alias("self"))
    named = leaves.withColumn("category", frame_rules.cpu_category(F.col("frame")))
    return rank.per_group(named, ["category"], [F.desc("self"), F.col("frame")], 8).select("category", "frame", "self", "rank")


@query("A14_unresolved_modules", f"WITH {CPU} SELECT coalesce(nullif(regexp_extract(names[1], '^(.+)\\+', 1), ''), '<unknown>') AS module, sum(weight) AS self FROM cf WHERE c[1] = 'Unresolved' GROUP BY 1")
def unresolved_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _cpu_stacks(spark, sf_dir).filter(F.size("frames") > 0).groupBy(F.col("frames")[0].alias("frame")).agg(F.sum("weight").alias("self"))
    module = F.coalesce(F.nullif(F.regexp_extract("frame", r"^(.+)\+", 1), F.lit("")), F.lit("<unknown>"))
    return leaves.filter(frame_rules.cpu_category(F.col("frame")) == "Unresolved").groupBy(module.alias("module")).agg(F.sum("self").alias("self"))


SEEN_SQL = "[" + ", ".join(str(list(s)) for s in SEEN) + "]"
ROLE = """CASE WHEN runtime >= 0.5 THEN 'Runtime infrastructure'
WHEN samples >= 50 AND last_ms - first_ms >= 1000 AND managed <= 0.05 AND top_share >= 0.95 AND NOT evidence THEN CASE WHEN worker < 0.5 THEN 'Parked' WHEN park_of_wait >= 0.75 THEN 'Idle pool worker' ELSE 'Blocked pool worker' END
WHEN wait < 0.5 AND NOT evidence THEN 'Active' WHEN worker < 0.5 THEN 'Blocked' WHEN park_of_wait >= 0.75 THEN 'Active' ELSE 'Blocked pool worker' END"""
PROFILE = f"""{CON}, st AS (SELECT * FROM (VALUES {_values(STACKS)}) t(i, f, wait, park, worker, runtime)),
vw AS (SELECT tid % 8 AS tid, rel_ms, {SEEN_SQL}[tid % 8 + 1][k % 4 + 1] AS stack_index, CASE WHEN tid % 8 IN (4, 6) THEN k % 3 = 0 ELSE k % 40 = 0 END AS managed FROM ev WHERE kind = 'view'),
tp AS (SELECT tid, CAST(sum(n) AS BIGINT) AS top FROM (SELECT tid, n, row_number() OVER (PARTITION BY tid ORDER BY n DESC, stack_index) AS place FROM (SELECT tid, stack_index, count(*) AS n FROM vw GROUP BY ALL)) WHERE place <= 3 GROUP BY 1),
sa AS (SELECT vw.tid, count(*) AS samples, avg(CAST(managed AS INTEGER)) AS managed, avg(wait) AS wait, avg(worker) AS worker, avg(runtime) AS runtime, coalesce(sum(park) / nullif(sum(wait), 0), 0) AS park_of_wait, min(rel_ms) AS first_ms, max(rel_ms) AS last_ms FROM vw JOIN st ON stack_index = i GROUP BY 1),
wa AS (SELECT tid % 8 AS tid, count(*) AS waits, sum(duration_ms) AS wait_ms FROM co GROUP BY 1), ow AS (SELECT owner + 5 AS tid, count(*) AS owned FROM co WHERE owner <> 0 GROUP BY 1),
p0 AS (SELECT coalesce(sa.tid, wa.tid, ow.tid) AS tid, coalesce(samples, 0) AS samples, coalesce(managed, 0) AS managed, coalesce(wait, 0) AS wait, coalesce(worker, 0) AS worker, coalesce(runtime, 0) AS runtime, coalesce(park_of_wait, 0) AS park_of_wait, coalesce(top / samples, 0) AS top_share, coalesce(waits, 0) AS waits, coalesce(wait_ms, 0) AS wait_ms, coalesce(owned, 0) AS owned, first_ms, last_ms FROM sa JOIN tp USING (tid) FULL JOIN wa ON sa.tid = wa.tid FULL JOIN ow ON ow.tid = coalesce(sa.tid, wa.tid)),
pf AS (SELECT *, waits > 0 AND coalesce(wait_ms / nullif(last_ms - first_ms, 0), 0) >= 0.01 AS evidence FROM p0),
pr2 AS (SELECT *, {ROLE} AS role FROM pf)"""
ORDER = "list_position(['Active', 'Blocked pool worker', 'Blocked', 'Idle pool worker', 'Parked', 'Runtime infrastructure'], role)"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight threads with stacks of their own, and owners of locks that were never sampled."""
    ev = tables.trace_events(spark, sf_dir).filter("kind = 'view'").withColumn("thread", F.col("tid") % 8)
    seen = F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in SEEN]), (F.col("thread") + 1).cast("int")), (F.col("k") % 4 + 1).cast("int"))
    managed = F.when(F.col("thread").isin(4, 6), F.col("k") % 3 == 0).otherwise(F.col("k") % 40 == 0)
    samples = ev.select(F.col("thread").alias("tid"), "rel_ms", seen.alias("stack_index"), managed.alias("managed"))
    known = spark.createDataFrame([(n, list(s[0])) for n, s in enumerate(STACKS)], "stack_index int, frames array<string>")
    con = contentions(spark, sf_dir)
    return threads.profiles(samples, known, con.select((F.col("tid") % 8).alias("tid"), "duration_ms"), con.filter("owner <> 0").select((F.col("owner") + 5).alias("tid")))


@query("A15_thread_profiles", f"WITH {PROFILE} SELECT tid, samples, round(managed, 6) AS managed, round(wait, 6) AS wait, round(worker, 6) AS worker, round(park_of_wait, 6) AS park_of_wait, round(top_share, 6) AS top_share, waits, round(wait_ms, 3) AS wait_ms, owned, first_ms, last_ms FROM pr2")
def thread_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = ("managed", "wait", "worker", "park_of_wait", "top_share")
    return _profiles(spark, sf_dir).select("tid", "samples", *[F.round(c, 6).alias(c) for c in shares], "waits", F.round("wait_ms", 3).alias("wait_ms"), "owned", "first_ms", "last_ms")


@query("A16_thread_roles", f"WITH {PROFILE} SELECT tid, role FROM pr2")
def thread_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).select("tid", "role")


@query("A17_role_totals", f"WITH {PROFILE} SELECT role, count(*) AS n, CAST(sum(samples) AS BIGINT) AS samples, {ORDER} >= 4 AS benign FROM pr2 GROUP BY role")
def role_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _profiles(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.sum("samples").alias("samples"))
    return sums.withColumn("benign", threads.role_order(F.col("role")) >= 3)


@query("W11_thread_rank", f"WITH {PROFILE} SELECT tid, CAST(row_number() OVER (ORDER BY {ORDER}, wait_ms DESC, samples DESC, tid) AS INTEGER) AS place FROM pr2 ORDER BY place LIMIT 40")
def thread_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [threads.role_order(F.col("role")), F.desc("wait_ms"), F.desc("samples"), F.col("tid")]
    first = _profiles(spark, sf_dir).orderBy(*by).limit(40)
    return first.select("tid", F.row_number().over(Window.partitionBy().orderBy(*by)).alias("place"))
