"""Thread profiles: what threads sampled, waited and owned, and the role that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frame_rules

#: Roles in the order in which a view shows them; the last three are benign.
ROLES = ("Active", "Blocked pool worker", "Blocked", "Idle pool worker", "Parked", "Runtime infrastructure")

# Thresholds of the roles.
OF_THREAD = 0.5  # share of stacks that makes a thread a pool worker, or the runtime's
PARKED_MANAGED, PARKED_TOP_STACKS, PARKED_SAMPLES, PARKED_SPAN_MS = 0.05, 0.95, 50, 1000.0
WAITS, EVIDENCE, HEALTHY_PARK = 0.5, 0.01, 0.75


def role_order(role: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLES)), role) - 1


def thread_role(p: str = "") -> Column:
    """The role of a profile (see profiles), by the first rule that holds.

    A thread that the runtime keeps waiting is never a finding. A thread looks parked if it hardly
    runs managed code and stays in a few stacks, unless waits for locks explain its stillness; a
    pool worker is only benign in the pool's own park.
    """
    c = lambda name: F.col(p + name)
    span = c("last_ms") - c("first_ms")
    evidence = (c("waits") > 0) & (F.coalesce(F.try_divide(c("wait_ms"), span), F.lit(0.0)) >= EVIDENCE)
    parked = ~evidence & (c("samples") >= PARKED_SAMPLES) & (span >= PARKED_SPAN_MS) & (c("managed") <= PARKED_MANAGED) & (c("top_share") >= PARKED_TOP_STACKS)
    worker, healthy = c("worker") >= OF_THREAD, c("park_of_wait") >= HEALTHY_PARK
    still = F.when(~worker, "Parked").when(healthy, "Idle pool worker").otherwise("Blocked pool worker")
    waiting = F.when(~worker, "Blocked").when(healthy, "Active").otherwise("Blocked pool worker")
    return F.when(c("runtime") >= OF_THREAD, "Runtime infrastructure").when(parked, still).when((c("wait") >= WAITS) | evidence, waiting).otherwise("Active")


def profiles(samples: DataFrame, known: DataFrame, waits: DataFrame, owners: DataFrame) -> DataFrame:
    """One row for each thread that sampled, waited or owned a lock, with its role.

    samples has tid, rel_ms, stack_index and managed; known has stack_index and frames (leaf first);
    waits has tid and duration_ms; owners has tid. managed, wait, worker, runtime are shares of the
    samples, park_of_wait the share of the pool's park in those that wait, top_share that of the
    three most sampled stacks. Samples without a stack are left out. Stacks are judged once each.
    """
    leaf = F.get(F.col("frames"), 0)
    judged = known.filter(F.size("frames") > 0).select(
        "stack_index",
        frame_rules.is_idle(leaf).cast("int").alias("s_wait"),
        frame_rules.any_of(leaf, frame_rules.POOL_PARK_PREFIXES).cast("int").alias("s_park"),
        frame_rules.on_pool_worker(F.col("frames")).cast("int").alias("s_worker"),
        frame_rules.of_runtime(F.col("frames")).cast("int").alias("s_runtime"),
    )
    # samples are counted by stack before stacks are looked up
    counts = samples.groupBy("tid", "stack_index").agg(F.count("*").alias("n"), F.count_if("managed").alias("n_managed"), F.min("rel_ms").alias("first_ms"), F.max("rel_ms").alias("last_ms"))
    placed = counts.join(judged, "stack_index").withColumn("place", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("n"), "stack_index")))
    part = lambda c: F.sum(F.col("n") * F.col(f"s_{c}")) / F.sum("n")
    own = placed.groupBy("tid").agg(
        F.sum("n").alias("samples"),
        (F.sum("n_managed") / F.sum("n")).alias("managed"),
        *[part(c).alias(c) for c in ("wait", "worker", "runtime")],
        F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("s_park")), F.sum(F.col("n") * F.col("s_wait"))), F.lit(0.0)).alias("park_of_wait"),
        (F.sum(F.when(F.col("place") <= 3, F.col("n")).otherwise(0)) / F.sum("n")).alias("top_share"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
    )
    waited = waits.groupBy("tid").agg(F.count("*").alias("waits"), F.sum("duration_ms").alias("wait_ms"))
    owned = owners.groupBy("tid").agg(F.count("*").alias("owned"))
    every = own.join(waited, "tid", "full_outer").join(owned, "tid", "full_outer")
    every = every.fillna(0, ["samples", "managed", "wait", "worker", "runtime", "park_of_wait", "top_share", "waits", "wait_ms", "owned"])
    return every.withColumn("role", thread_role())


def top_stacks(samples: DataFrame, n: int = 3) -> DataFrame:
    """The n most sampled stacks of each thread, ties to the smaller index."""
    counts = samples.groupBy("tid", "stack_index").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("n"), "stack_index"))
    return counts.withColumn("place", place).filter(F.col("place") <= n)


def lock_ranks(waits: DataFrame, workers: DataFrame) -> DataFrame:
    """lock_id, rank, n, total_ms, max_ms, waiters, worker_waiters and worker_waits, the lock with most waiting first.

    workers has the tid of each pool worker once. Lock 0 is none. A row for each lock is ranked in
    one window, after the sums.
    """
    known = waits.filter("lock_id <> 0").join(workers.withColumn("__worker", F.lit(True)), "tid", "left")
    own = F.when(F.col("__worker"), F.col("tid"))
    sums = known.groupBy("lock_id").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("total"), F.max("duration_ms").alias("max_ms"), F.count_distinct("tid").alias("waiters"), F.count_distinct(own).alias("worker_waiters"), F.count(own).alias("worker_waits")
    )
    return sums.select("lock_id", F.row_number().over(Window.orderBy(F.desc("total"), "lock_id")).alias("rank"), "n", F.round("total", 3).alias("total_ms"), "max_ms", "waiters", "worker_waiters", "worker_waits")
