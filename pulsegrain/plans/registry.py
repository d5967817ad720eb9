"""Names queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The driver's events as a trace: see sources.tables.trace_events.
EV = """ev AS (
  SELECT event_id AS seq, epoch_us(ts) AS us, CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000.0 AS DOUBLE) AS rel_ms,
    user_id AS tid, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
)"""
ALLOC = f"""{EV}, al AS (
  SELECT seq, rel_ms, tid, concat('T', k % 20) AS type_name, CAST(floor(value * 1000) AS BIGINT) AS bytes, CAST(seq % 3 AS INTEGER) AS size_class, k % 4 AS heap
  FROM ev WHERE kind = 'purchase'
)"""
EXC = f"""{EV}, ex AS (
  SELECT seq, rel_ms, tid, concat('E', k % 60) AS type_name, concat('m', seq) AS message FROM ev WHERE kind = 'error'
)"""
#: Contentions: a click is a wait's start and the next click or purchase of the user ends it.
CON = f"""{EV}, pr AS (
  SELECT *, lag(kind) OVER w AS prior, lag(rel_ms) OVER w AS start_ms, lag(seq) OVER w AS start_seq FROM ev WHERE kind IN ('click', 'purchase') WINDOW w AS (PARTITION BY tid ORDER BY seq)
), co AS (
  SELECT tid, start_ms, rel_ms AS stop_ms, CAST(value * 1000 AS DOUBLE) AS duration_ms, seq, start_seq, k % 7 AS lock_id, k % 5 AS owner, CAST(k % 11 AS BIGINT) AS stack_index
  FROM pr WHERE kind = 'purchase' AND prior = 'click'
)"""
STACKS = """st AS (
  SELECT [p_type, p_brand, n_name, r_name] AS frames, CAST(sum(l_quantity) AS DOUBLE) AS weight, count(*) AS ticks
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
)"""


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register
