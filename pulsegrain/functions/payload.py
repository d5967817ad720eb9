"""Fields of binary event payloads as column expressions: little-endian numbers and text.

Payloads stay in the JVM: a number is read from the hex form of its bytes, turned around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The lower half of each byte of a long.
_LOW = 0x0F0F0F0F0F0F0F0F


def halves_swapped(value: Column) -> Column:
    """A long with the two hex digits of each byte exchanged."""
    return F.shiftleft(value.bitwiseAND(F.lit(_LOW)), 4).bitwiseOR(F.shiftrightunsigned(value, 4).bitwiseAND(F.lit(_LOW)))


def _raw(payload: Column, at: Column, size: int) -> Column:
    """`size` bytes from a 0-based offset as a number, the first byte the lowest; null if the payload is too short.

    Digits turned around as a whole leave the two of each byte to be exchanged.
    """
    turned = F.conv(F.reverse(F.hex(F.substring(payload, at + 1, F.lit(size)))), 16, -10).cast("bigint")
    return F.when(F.length(payload) >= at + size, halves_swapped(turned))


def unsigned(payload: Column, at: int | Column, size: int) -> Column:
    """A number of up to 4 bytes; null if the payload is too short."""
    return _raw(payload, F.lit(at) if isinstance(at, int) else at, size)


def signed(payload: Column, at: int | Column, size: int) -> Column:
    """A number of 1 to 8 bytes in two's complement."""
    value = unsigned(payload, at, size)
    return value if size == 8 else F.shiftright(F.shiftleft(value, 64 - 8 * size), 64 - 8 * size)


def float64(payload: Column, at: int | Column) -> Column:
    """An IEEE double; infinities and NaN come back as null."""

    def value(bits: Column) -> Column:
        exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF))
        fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
        size = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-1074))).otherwise((fraction / float(1 << 52) + 1) * F.pow(F.lit(2.0), exponent - 1023))
        return F.when(exponent < 0x7FF, F.when(bits < 0, -size).otherwise(size))

    # the bits are named many times and read once
    return F.get(F.transform(F.array(signed(payload, at, 8)), value), 0)


def utf16(payload: Column, at: int | Column) -> tuple[Column, Column]:
    """(text, offset behind it) of a text that a pair of zero bytes ends."""
    at = F.lit(at) if isinstance(at, int) else at
    rest = F.hex(F.substring(payload, at + 1, F.length(payload)))
    units = F.regexp_extract(rest, "^((?!0000)[0-9A-F]{4})*+", 0)
    return F.decode(F.unhex(units), "UTF-16LE"), at + F.length(units) / 2 + 2


def utf16_run(payload: Column, at: int | Column, n: int) -> tuple[list[Column], Column]:
    """(texts, offset behind the last) of n texts in turn, found in one pass: the offset of one in that of the next would read the first 2**n times."""
    at = F.lit(at) if isinstance(at, int) else at
    rest = F.hex(F.substring(payload, at + 1, F.length(payload)))
    units = F.regexp_extract_all(rest, F.lit("(((?!0000)[0-9A-F]{4})*+)(0000)?"), F.lit(1))
    texts = [F.decode(F.unhex(F.coalesce(F.get(units, k), F.lit(""))), "UTF-16LE") for k in range(n)]
    return texts, at + F.length(F.array_join(F.slice(units, 1, n), "")) / 2 + 2 * n


def gc_start(payload: Column) -> Column:
    """id, generation, reason and type of a collection's start; only the id in short payloads."""
    return F.struct(*[signed(payload, at, 4).alias(name) for name, at in (("id", 0), ("generation", 4), ("reason", 8), ("type", 12))])


def gc_end(payload: Column, version: Column) -> Column:
    depth = F.when(version >= 1, signed(payload, 4, 4)).otherwise(signed(payload, 4, 2))
    return F.struct(signed(payload, 0, 4).alias("id"), depth.alias("generation"))


def exception(payload: Column, pointer_size: int = 8) -> Column:
    """type, message, hresult and flags of a thrown exception."""
    kind, behind = utf16(payload, 0)
    behind = behind.cast("int")
    message, after = utf16(payload, behind)
    after = after.cast("int")
    return F.struct(kind.alias("type"), message.alias("message"), signed(payload, after + pointer_size, 4).alias("hresult"), unsigned(payload, after + pointer_size + 4, 2).alias("flags"))
