"""Stateful operators over live events, one key's state at a time.

They need a state store that keeps single values, which the session names:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

JIT_OUT = "pid long, method_id long, seq long, tier int, tier_up boolean, load_ms double"
BATCH_OUT = "pid long, seq long, gc_id long, bytes long"


class JitTimer(StatefulProcessor):
    """Waits for the load of a method's latest start; a start before it replaces the one that waits.

    Once `keep_ms` of event time have passed without an event the method is forgotten.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "ts_ms double")
        self.loads = handle.getValueState("loads", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        pid, method_id = key
        waiting = self.waiting.get()[0] if self.waiting.exists() else None
        loads = self.loads.get()[0] if self.loads.exists() else 0
        latest = 0
        for r in sorted(rows, key=lambda r: r.seq):
            latest = max(latest, int(r.ts.timestamp() * 1000))
            if r.kind == "start":
                waiting = r.ts.timestamp() * 1000
            elif waiting is not None:
                yield Row(pid=pid, method_id=method_id, seq=r.seq, tier=r.tier, tier_up=loads > 0, load_ms=round(r.ts.timestamp() * 1000 - waiting, 3))
                waiting, loads = None, loads + 1
        if waiting is None:
            self.waiting.clear()
        else:
            self.waiting.update((waiting,))
        self.loads.update((loads,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(latest + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        self.waiting.clear()
        self.loads.clear()
        return iter(())

    def close(self) -> None:
        pass


def jit_durations(events: DataFrame, late: str = "1 minute", keep_ms: int = 600_000) -> DataFrame:
    """pid, method_id, seq, tier, tier_up and load_ms of each load that a start came before.

    events is a stream of pid, method_id, seq, kind (start, load), tier and ts. A method is a key of
    its own, so a busy process spreads over tasks.
    """
    keyed = events.withWatermark("ts", late).groupBy("pid", "method_id")
    return keyed.transformWithState(JitTimer(keep_ms), JIT_OUT, "Append", "EventTime")


class LatestCollection(StatefulProcessor):
    """Gives each batch of allocations the latest collection of its process."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "gc_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        latest = self.latest.get()[0] if self.latest.exists() else None
        for r in sorted(rows, key=lambda r: r.seq):
            if r.kind == "gc":
                latest = r.gc_id
            else:
                yield Row(pid=key[0], seq=r.seq, gc_id=latest, bytes=r.bytes)
        if latest is not None:
            self.latest.update((latest,))

    def close(self) -> None:
        pass


def latest_collections(messages: DataFrame) -> DataFrame:
    """pid, seq, gc_id and bytes of each message with allocations; messages has pid, seq, kind (gc, alloc), gc_id and bytes."""
    return messages.groupBy("pid").transformWithState(LatestCollection(), BATCH_OUT, "Append", "None")
