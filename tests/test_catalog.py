"""Each query against its SQL in DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrain.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    if name in catalog.ORACLE_SQL:
        sql = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(sql.columns) == columns
        assert got == sorted(sql.project(",".join(columns)).fetchall(), key=str)
    else:
        assert got


def _over_events(spark, tmp_path, name, rows):
    """Rows of a query and of its SQL over events (seq, seconds, user, kind, value, k)."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, TIMESTAMP '2024-01-01' + to_microseconds(?::BIGINT), ?, ?, ?, ?)", [(e, int(t * 1e6), u, kind, v, f'{{"k": {k}}}') for e, t, u, kind, v, k in rows])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    sql = con.execute(f"SELECT {','.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str), sorted(sql, key=str)


def test_bytes_go_to_the_least_later_collection(spark, tmp_path):
    """One at the tick's own time is not later; a smaller number may come days later; the last ticks have none."""
    day = 86_400
    rows = [(1, 0, 1, "purchase", 1.5, 0), (9, 0, 1, "signup", 0.0, 0), (8, 5, 1, "signup", 0.0, 0), (2, 6, 1, "purchase", 2.0, 0), (7, 3 * day, 1, "signup", 0.0, 0), (3, 3 * day, 1, "purchase", 4.0, 0)]
    rows += [(5, 5 * day, 1, "signup", 0.0, 0), (6, 5 * day + 1, 1, "signup", 0.0, 0), (4, 6 * day, 1, "purchase", 8.0, 0)]
    got, want = _over_events(spark, tmp_path, "A33_bytes_between_gcs", rows)
    assert got == want and (7500, 5) in got


def test_entry_imports_without_the_training_operators(tmp_path):
    """A copy without them still lists the other queries, in a process of its own."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "pulsegrain", tmp_path / "pulsegrain", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q), len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=60)
    assert run.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))], run.stderr


@pytest.mark.parametrize("name", ["W4_block_runs", "J16_gap_neighbours"])
def test_tasks_over_objects_grow_in_number_and_not_in_size(spark, monkeypatch, name):
    """6,000 sales, 300 to a task, lie in more tasks than the session's four partitions."""
    monkeypatch.setattr("pulsegrain.sources.tables.ROWS_A_TASK", 300, raising=False)
    parts = catalog.QUERIES[name](spark, SF).groupBy(F.spark_partition_id().alias("part")).count()
    assert parts.count() > 4


@pytest.mark.parametrize("name", ["J1_symbolize", "J3_native_lookup", "J15_sample_kinds"])
def test_range_joins_of_sales_have_tasks_by_their_rows(spark, monkeypatch, name):
    """6,000 sales, 300 to a task, are looked up by 20 tasks for each length of range, and with the same rows as by a few."""
    want = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()), key=str)
    monkeypatch.setattr("pulsegrain.sources.tables.ROWS_A_TASK", 300, raising=False)
    df = catalog.QUERIES[name](spark, SF)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect()), key=str) == want
