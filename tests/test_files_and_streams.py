import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrain.operators import jit
from pulsegrain.sources import files
from pulsegrain.streaming import live, metrics, projectors, state, watch


def test_gcinfo(spark, tmp_path):
    (tmp_path / "a.gcinfo").write_text("<Log><GCEvent><Id>1,234</Id><Generation>2</Generation><StartMs>1,000.5</StartMs><DurationMs>2.5</DurationMs><Gen0Size>1,000,000</Gen0Size><LOHSize>5</LOHSize></GCEvent></Log>")
    r = files.read_gcinfo(spark, str(tmp_path / "a.gcinfo")).first()
    assert (r.id, r.generation, r.end_ms, r.gen0_size, r.poh_size) == (1234, 2, 1003.0, 1_000_000, 0)


def test_ticks(spark, tmp_path):
    ticks = [(0, 1), (-5, 2**40), (2**31 - 1, -7)]
    (tmp_path / "t.bin").write_bytes(b"".join(struct.pack("<iq", *t) for t in ticks))
    (tmp_path / "empty.bin").write_bytes(b"")
    assert sorted(map(tuple, files.read_ticks(spark, str(tmp_path / "*.bin")).collect())) == sorted(ticks)
    files.write_ticks(spark.createDataFrame([(0.5, 3), (1.5, 4), (2.5, 5)], "rel_ms double, bytes int"), str(tmp_path / "out"))
    assert sorted(r.ms for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 2]


def test_ticks_come_apart_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TICK_BLOCK", 3)
    for n in (0, 1, 3, 4, 10):
        ticks = [(k - 2, (-1) ** k * 10**k) for k in range(n)]
        content = b"".join(struct.pack("<iq", *t) for t in ticks) + b"tail"
        got = files.decode_ticks(spark.createDataFrame([("a", bytearray(content)), ("b", None)], "name string, content binary")).collect()
        assert [(r.ms, r.bytes) for r in sorted(got, key=lambda r: r.place)] == ticks and [r.place for r in sorted(got)] == list(range(n))


def test_metrics_are_written_without_powers_of_ten(spark):
    said = {12345678.5: "12345678.5", 1e7: "10000000", -98765432109.125: "-98765432109.125", 0.25: "0.25", 0.00012345678901234567: "0.00012345678901234567", 4503599627370495.5: "4503599627370495.5", 0.1: "0.1", 2.5e15: "2500000000000000"}
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(said)], "seq long, v double").withColumn("p", F.col("seq"))
    lines = metrics.exposition(metrics.latest(metrics.samples(rows, (metrics.Metric("size", "v", ("p",)),)))).collect()
    assert sorted(r.line for r in lines) == sorted(f'size{{p="{k}"}} {text}' for k, text in enumerate(said.values()))


def test_metrics_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    table = (metrics.Metric("size", "v", ("p", "name")), metrics.Metric("runs", "1", ("p",), "counter"))
    schema = "seq long, p long, name string, v double"
    rows = [(1, 1, "a", 5.0), (2, 1, "a", 2.5), (3, 1, 'x"\\\n', 7.0), (4, 2, None, None)]
    later = [(5, 1, "a", 4.0), (6, 2, "b", 1e16)]
    batch = {r.line for r in metrics.exposition(metrics.latest(metrics.samples(spark.createDataFrame(rows + later, schema), table)), "t_").collect()}
    assert batch == {'t_size{p="1",name="a"} 4', 't_size{p="1",name="x\\"\\\\\\n"} 7', 't_size{p="2",name="b"} 1.0E16', 't_runs{p="1"} 4', 't_runs{p="2"} 2'}
    source = tmp_path / "in"
    for part in (rows, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = metrics.samples(spark.readStream.schema(schema).parquet(str(source)), table)
        metrics.publish(stream, str(tmp_path / "out"), str(tmp_path / "check"), "t_").awaitTermination()
    assert {r.value for r in spark.read.text(str(tmp_path / "out/batch=1")).collect()} == batch
    assert len({m.name for m in metrics.ALLOCATION + metrics.METHOD + metrics.COLLECTION + metrics.HEAP}) == 33


def test_documents_and_reports(spark, tmp_path):
    census = spark.createDataFrame([("T", 1, 2, 30), ("U", 1, 2, 40)], "type string, n long, exclusive long, retained long")
    assert [r.line.split()[-1] for r in files.census_report(census).collect()] == ["U", "T"]
    files.write_document({"census": census}, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc/census")).count() == 2


def drain(spark, make, schema, batches, tmp_path, mode="append", name="out"):
    source = tmp_path / "in"
    source.mkdir()
    stream = make(spark.readStream.schema(schema).parquet(str(source)))
    rows = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / name)).collect()
    return rows


def test_collections_come_when_complete_in_any_order(spark, tmp_path):
    schema = "pid long, seq long, kind string, gc_id long, value double"
    first = [(1, 1, "alloc", None, 10.0), (1, 2, "gc_start", 7, 2.0), (1, 3, "stats", 7, 1.5), (1, 4, "heap", 7, 0.0), (2, 5, "alloc", None, 1.0)]
    second = [(1, 6, "alloc", None, 5.0), (1, 7, "heap", 7, 1.0), (1, 8, "gc_start", 8, 1.0), (1, 9, "heap", 8, 0.0), (1, 10, "stats", 8, 2.0)]
    got = drain(spark, live.assemble_gcs, schema, [first, second], tmp_path)
    assert sorted((r.pid, r.gc_id, r.pause, r.heaps, r.alloc_bytes, r.alloc_ticks) for r in got) == [(1, 7, 1.5, 2, 15, 2), (1, 8, 2.0, 1, 0, 0)]
    lines = live.gauges(spark.createDataFrame(got)).collect()
    assert 'gc_count{pid="1"} 2.0' in {r.line for r in lines}


def test_windows_wait_for_the_watermark(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(at(0), "a", 1), (at(0), "a", 1), (at(1), "b", 1)]
    later = [(at(30), "a", 1)]
    too_late = [(at(0), "a", 1), (at(59), "a", 1)]
    got = drain(spark, live.event_rates, "ts timestamp, kind string, pid long", [rows, later, too_late], tmp_path)
    assert ("a", 2) in {(r.kind, r.n) for r in got} and ("b", 1) in {(r.kind, r.n) for r in got}


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.fixture
def keyed_state(spark):
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.unset(STATE_STORE[0])


def test_jit_starts_are_armed_again_and_survive_a_restart(spark, tmp_path, keyed_state):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    schema = "pid long, method_id long, seq long, kind string, tier int, ts timestamp"
    first = [(1, 9, 1, "start", 0, at(1)), (1, 9, 2, "start", 0, at(2)), (1, 9, 3, "load", 0, at(5)), (1, 8, 4, "load", 0, at(6)), (2, 9, 5, "start", 0, at(6)), (1, 9, 6, "start", 1, at(7))]
    second = [(1, 9, 7, "load", 1, at(9)), (1, 9, 8, "load", 1, at(10)), (2, 9, 9, "load", 2, at(8))]
    got = drain(spark, state.jit_durations, schema, [first, second], tmp_path)  # each batch is a run of its own
    want = [(1, 9, 3, 0, False, 3000.0), (1, 9, 7, 1, True, 2000.0), (2, 9, 9, 2, False, 2000.0)]
    assert sorted(map(tuple, got)) == want
    batch = spark.createDataFrame(first + second, schema).withColumn("ts_ms", F.unix_micros("ts") / 1000)
    assert sorted(map(tuple, jit.jit_durations(batch).collect())) == want


def test_forgotten_methods_are_not_tiered_up(spark, tmp_path, keyed_state):
    at = lambda m, s=0: datetime(2024, 1, 1, m // 60, m % 60, s)
    schema = "pid long, method_id long, seq long, kind string, tier int, ts timestamp"
    runs = [[(1, 9, 1, "start", 0, at(0)), (1, 9, 2, "load", 0, at(0, 1))], [(1, 7, 3, "start", 0, at(90))], [(1, 7, 4, "load", 0, at(91)), (1, 9, 5, "start", 0, at(91))], [(1, 9, 6, "load", 0, at(92))]]
    got = drain(spark, state.jit_durations, schema, runs, tmp_path)
    assert sorted((r.method_id, r.seq, r.tier_up) for r in got) == [(7, 4, False), (9, 2, False), (9, 6, False)]


def test_allocations_go_to_the_latest_collection(spark, tmp_path, keyed_state):
    schema = "pid long, seq long, kind string, gc_id long, bytes long"
    first = [(1, 1, "alloc", None, 5), (1, 2, "gc", 7, None), (1, 3, "alloc", None, 6), (2, 4, "gc", 1, None)]
    second = [(1, 5, "alloc", None, 7), (1, 6, "gc", 8, None), (1, 7, "alloc", None, 8), (2, 8, "alloc", None, 9)]
    want = [(1, 1, None, 5), (1, 3, 7, 6), (1, 5, 7, 7), (1, 7, 8, 8), (2, 8, 1, 9)]
    assert sorted(map(tuple, drain(spark, state.latest_collections, schema, [first, second], tmp_path)), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, jit.latest_collections(spark.createDataFrame(first + second, schema)).collect()), key=str) == sorted(want, key=str)


def test_collections_are_complete_in_batch_as_in_the_stream(spark, tmp_path):
    rng = random.Random(3)
    rows, open_gc = [], {}
    for seq in range(400):
        pid = rng.randrange(3)
        kind = rng.choice(["alloc", "gc_start", "heap", "heap", "stats"])
        if kind == "gc_start":
            open_gc[pid] = seq
        gc_id = open_gc.get(pid, 999) if rng.random() < 0.9 else 998
        rows.append((pid, seq, kind, None if kind == "alloc" else seq if kind == "gc_start" else gc_id, float(rng.randint(1, 3) if kind == "gc_start" else rng.randrange(50))))
    schema = "pid long, seq long, kind string, gc_id long, value double"
    got = drain(spark, live.assemble_gcs, schema, [rows[:170], rows[170:]], tmp_path)
    batch = jit.complete_collections(spark.createDataFrame(rows, schema)).collect()
    pick = lambda rs: sorted((r.pid, r.gc_id, r.pause, r.heaps, r.alloc_bytes, r.alloc_ticks) for r in rs)
    assert pick(got) == pick(batch) and len(batch) > 10


def test_sessions_in_batches(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([(1, at(1)), (1, at(3)), (1, at(5)), (1, at(6)), (1, at(20))], "pid long, ts timestamp")
    assert sorted(r.n for r in live.sessions(df, "3 seconds").collect()) == [1, 4]


def test_late_rows_are_all_accounted_for(spark, tmp_path):
    rng = random.Random(5)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "ts timestamp, kind string, pid long"
    batches = [[(at(60 * k + rng.randrange(-300, 60)), rng.choice("ab"), rng.randrange(2)) for _ in range(40)] for k in range(5)]
    source = tmp_path / "in"
    source.mkdir()
    paths = [str(tmp_path / n) for n in ("ontime", "late", "marks", "check")]
    latest, late = None, []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        live.route_late(spark.readStream.schema(schema).parquet(str(source)), *paths, 60_000_000).awaitTermination(120)
        late += [(ts, (latest - ts).total_seconds() - 60) for ts, _, _ in batch if latest and (latest - ts).total_seconds() > 60]
        latest = max([ts for ts, _, _ in batch] + ([latest] if latest else []))
    on_time, behind = spark.read.parquet(paths[0]).drop("batch"), spark.read.parquet(paths[1]).drop("batch")
    assert sorted((r.ts, r.late_us / 1e6) for r in behind.collect()) == sorted(late) and late
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    both = on_time.select("ts", "kind", "pid").unionByName(behind.select("ts", "kind", "pid"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, every.collect()))
    for slide in (None, "30 seconds"):
        counts = lambda df, s=slide: sorted(map(tuple, live.event_rates(df, "1 minute", slide=s).collect()))
        assert counts(both) == counts(every) and sum(n for _, _, n in counts(every)) == 200 * (2 if slide else 1)


def test_late_rows_by_their_place_in_the_order(spark):
    rng = random.Random(6)
    rows = [(k, 100 * k + rng.choice([0, -350, 90])) for k in range(200)]
    got = {r.seq: r.late_us for r in live.late_rows(spark.createDataFrame(rows, "seq long, us long"), "us", "seq", 120, cell=7).collect()}
    want = {}
    for k, us in rows[1:]:
        mark = max(u for i, u in rows if i < k) - 120
        if us < mark:
            want[k] = mark - us
    assert got == want


def test_a_watch_stops_by_each_of_its_rules(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "src"))
    stream = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "src"))
    count = lambda b: b.groupBy().count()
    why, cycles = watch.watch(stream(), count, str(tmp_path / "r1"), str(tmp_path / "c1"), "1 second", duration_s=8, name="by-duration")
    assert why == "duration" and spark.read.parquet(str(tmp_path / "r1")).first()[0] == 5
    stop = tmp_path / "stop"
    stop.write_text("")
    assert watch.watch(stream(), count, str(tmp_path / "r2"), str(tmp_path / "c2"), stop_file=str(stop), name="by-file")[0] == "stop file" and not stop.exists()
    calls = []

    def fails(batch):
        calls.append(1)
        if len(calls) == 2:
            return count(batch)  # a good report sets the count back
        raise RuntimeError("no report")

    rates = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    why, _ = watch.watch(rates, fails, str(tmp_path / "r3"), str(tmp_path / "c3"), "0 seconds", duration_s=90, most_errors=3, name="by-errors")
    assert why == "errors" and len(calls) >= 5


def test_a_projector_shows_up_in_sql(spark):
    @projectors.projector("errors_by_thread")
    def errors(events):
        return events.filter("kind = 'error'").groupBy("tid").agg(F.count("*").alias("n"))

    try:
        projectors.install(spark, spark.createDataFrame([(1, "error"), (1, "view"), (1, "error"), (2, "error")], "tid int, kind string"))
        assert sorted(map(tuple, spark.sql("SELECT tid, n FROM errors_by_thread").collect())) == [(1, 2), (2, 1)]
        with pytest.raises(ValueError, match="already"):
            projectors.projector("errors_by_thread")(errors)
    finally:
        del projectors.PROJECTORS["errors_by_thread"]
    body = struct.pack("<iihqq", 0, 3, 1, 10, -20)  # its count says three
    spark.createDataFrame([(1, bytearray(body)), (2, None), (3, bytearray(b"x"))], "src int, payload binary").createOrReplaceTempView("some_payloads")
    assert sorted(map(tuple, spark.sql("SELECT src, target, ordinal FROM some_payloads, LATERAL bulk_references(payload)").collect())) == [(1, -20, 1), (1, 10, 0)]


def test_snapshots_overwrite_their_report(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "src"))
    query = live.snapshots(stream, lambda b: b.groupBy().count(), str(tmp_path / "report"), str(tmp_path / "c"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "report")).first()[0] == 5
