"""Event payloads decoded by tables of their fields.

A layout lists fields in order. Offsets are whole numbers up to the first text or counted array and
expressions behind it, so several texts in turn need no code of their own. A field that came with a
later version, or only stands in payloads of some length, is null in others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .payload import float64, halves_swapped, signed, unsigned, utf16, utf16_run


@dataclass(frozen=True)
class Field:
    """kind is i1, i2, i4, i8, u1, u2, u4, f8, ptr, text, or array of ptr; `counted_by` names the field with an array's length."""

    name: str
    kind: str
    version: int = 0
    length: int = 0
    counted_by: str | None = None


# Fields of the runtime's events in the order of their payloads.
LAYOUTS: dict[str, tuple[Field, ...]] = {
    "suspend": (Field("reason", "i4"),),
    "heap_stats": (
        Field("size_0", "i8"), Field("promoted_0", "i8"), Field("size_1", "i8"), Field("promoted_1", "i8"), Field("size_2", "i8"), Field("promoted_2", "i8"), Field("size_3", "i8"), Field("promoted_3", "i8"),
        Field("finalization_size", "i8"), Field("finalization_count", "i8"), Field("pinned", "i4"), Field("sink_blocks", "i4"), Field("handles", "i4"),
        Field("instance", "i2", 1, 94), Field("size_4", "i8", 2, 110), Field("promoted_4", "i8", 2, 110),
    ),
    "global_history": (
        Field("youngest_desired", "i8"), Field("heaps", "i4"), Field("condemned_generation", "i4"), Field("gen0_reductions", "i4"), Field("reason", "i4"), Field("mechanisms", "i4"), Field("instance", "i2", 1, 30),
    ),
    "allocation_tick": (
        Field("amount", "i4"), Field("allocation_kind", "i4"), Field("instance", "i2", 1, 10), Field("amount_64", "i8", 2, 19), Field("type_id", "ptr", 2, 19), Field("type_name", "text", 2, 19), Field("heap", "i4", 2, 19),
    ),
    "contention_start": (Field("flags", "u1"), Field("instance", "i2"), Field("lock_id", "ptr", 2, 27), Field("object_id", "ptr", 2, 27), Field("owner", "i8", 2, 27)),
    "contention_stop": (Field("flags", "u1"), Field("instance", "i2"), Field("duration_ns", "f8", 0, 11)),
    "worker_thread": (Field("active", "i4"), Field("retired", "i4")),
    "pool_adjustment": (Field("throughput", "f8"), Field("workers", "i4"), Field("reason", "i4")),
    "pool_sample": (Field("throughput", "f8"),),
    "method": (
        Field("method_id", "ptr"), Field("module_id", "ptr"), Field("address", "ptr"), Field("size", "i4"), Field("token", "i4"), Field("flags", "i4"), Field("namespace", "text"), Field("name", "text"), Field("signature", "text"),
    ),
    "bulk_references": (Field("index", "i4"), Field("count", "i4"), Field("instance", "i2"), Field("targets", "array", counted_by="count")),
}

_SIZES = {"i1": 1, "i2": 2, "i4": 4, "i8": 8, "u1": 1, "u2": 2, "u4": 4, "f8": 8}


def _number(payload: Column, at: int | Column, kind: str, pointer_size: int) -> tuple[Column, int]:
    if kind == "ptr":
        return (signed if pointer_size == 8 else unsigned)(payload, at, pointer_size), pointer_size
    size = _SIZES[kind]
    if kind == "f8":
        return float64(payload, at), size
    return (signed if kind[0] == "i" else unsigned)(payload, at, size), size


def decode(payload: Column, layout: str | tuple[Field, ...], version: Column | None = None, pointer_size: int = 8) -> Column:
    """A struct of the layout's fields; those that end beyond the payload are null."""
    fields = LAYOUTS[layout] if isinstance(layout, str) else layout
    version = F.lit(1 << 30) if version is None else version
    at: int | Column = 0
    done: dict[str, Column] = {}
    texts: list[Column] = []
    for place, f in enumerate(fields):
        if texts:
            value, behind = texts.pop(0), at
        elif f.kind == "text":
            n = next((k for k, g in enumerate(fields[place:]) if g.kind != "text"), len(fields) - place)
            if n == 1:
                value, behind = utf16(payload, at)
            else:
                (value, *texts), behind = utf16_run(payload, at, n)
            behind = behind.cast("int")
        elif f.kind == "array":
            start = F.lit(at) if isinstance(at, int) else at
            count = F.greatest(F.coalesce(done[f.counted_by], F.lit(0)), F.lit(0)).cast("int")
            # entries beyond the payload's end are not there
            count = F.least(count, F.floor(F.greatest(F.length(payload) - start, F.lit(0)) / pointer_size).cast("int"))
            value = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), F.lit(1), count), lambda i, s=start: _number(payload, s + i * pointer_size, "ptr", pointer_size)[0])
            behind = start + count * pointer_size
        else:
            value, size = _number(payload, at, f.kind, pointer_size)
            behind = at + size
        there = (version >= f.version) & (F.length(payload) >= f.length)
        done[f.name], at = F.when(there, value), behind
    return F.struct(*[c.alias(name) for name, c in done.items()])


def little_endian(value: Column, size: int) -> Column:
    """A whole number as its bytes, the least significant first."""
    whole = value.cast("bigint").bitwiseAND(F.lit((1 << (8 * size)) - 1 if size < 8 else -1))
    return F.unhex(F.reverse(F.lpad(F.hex(halves_swapped(whole)), 2 * size, "0")))


def utf16_bytes(text: Column) -> Column:
    """A text with the pair of zero bytes that ends it."""
    return F.concat(F.encode(text, "UTF-16LE"), F.lit(b"\0\0"))
