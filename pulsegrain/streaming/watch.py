"""Snapshots of a stream until a rule says stop."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

#: Failed reports in a row that end a watch.
MOST_ERRORS = 5


class Cycles(StreamingQueryListener):
    """Counts the batches that queries of one name have finished, with or without rows."""

    def __init__(self, name: str):
        self.name, self.done, self.rows, self.ended = name, 0, 0, False
        self.ids: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.ids.add(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.name == self.name:
            self.done += 1
            self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended |= str(event.id) in self.ids


def watch(
    stream: DataFrame, report: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str = "10 seconds", stop_file: str | None = None, duration_s: float | None = None, most_errors: int = MOST_ERRORS, name: str = "watch", poll_s: float = 0.2
) -> tuple[str, Cycles]:
    """Overwrites a report with that of each batch until a rule stops it; (why, cycles).

    why is `stop file`, when that file appears (it is removed), `duration`, `errors`, after so many
    failed reports in a row, or `ended`. A failed report leaves the one before in place, and a good
    one sets the count of failures back. The stop file is looked for on the driver's machine.
    """
    failures = 0

    def write(batch: DataFrame, _: int) -> None:
        nonlocal failures
        try:
            # a report that fails half way does not touch the one before
            report(batch).write.mode("overwrite").parquet(f"{path}.next")
            batch.sparkSession.read.parquet(f"{path}.next").write.mode("overwrite").parquet(path)
            failures = 0
        except Exception:
            failures += 1

    cycles, began = Cycles(name), time.monotonic()
    spark = stream.sparkSession
    spark.streams.addListener(cycles)
    query = stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        while True:
            if stop_file is not None and os.path.exists(stop_file):
                os.remove(stop_file)
                return "stop file", cycles
            if duration_s is not None and time.monotonic() - began >= duration_s:
                return "duration", cycles
            if failures >= most_errors:
                return "errors", cycles
            if query.awaitTermination(poll_s):
                return "ended", cycles
    finally:
        query.stop()
        spark.streams.removeListener(cycles)
