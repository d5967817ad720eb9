"""Projectors by name: functions of a table of events, and table functions for bulk payloads in SQL."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

Projector = Callable[[DataFrame], DataFrame]

PROJECTORS: dict[str, Projector] = {}


def projector(name: str) -> Callable[[Projector], Projector]:
    """Registers a function from events to rows under a name."""

    def register(f: Projector) -> Projector:
        if name in PROJECTORS:
            raise ValueError(f"there is a projector {name} already")
        PROJECTORS[name] = f
        return f

    return register


def install(spark: SparkSession, events: DataFrame | None = None) -> None:
    """Makes the table functions known to SQL, and each projector's rows over `events` a view of its name."""
    spark.udtf.register("bulk_references", BulkReferences)
    if events is not None:
        for name, project in PROJECTORS.items():
            project(events).createOrReplaceTempView(name)


@udtf(returnType="target bigint, ordinal int")
class BulkReferences:
    """A row for each address of a bulk payload: index, count, instance, and so many addresses.

    A payload that ends before its count gives the addresses it has; null gives none.
    """

    def eval(self, payload: bytes) -> Iterator[tuple[int, int]]:
        if payload is None or len(payload) < 10:
            return
        count = min(struct.unpack_from("<i", payload, 4)[0], (len(payload) - 10) // 8)
        for k, (target,) in enumerate(struct.iter_unpack("<q", payload[10 : 10 + 8 * max(0, count)])):
            yield target, k
