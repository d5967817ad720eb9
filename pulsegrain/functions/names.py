"""Names of types, methods and symbols. Apply them to distinct names and join those back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def generic_name(name: Column) -> Column:
    """List`1[X] as List<X>."""
    opened = F.regexp_replace(name, r"`[0-9]+\[", "<")
    return F.when(opened != name, F.regexp_replace(opened, r"\]", ">")).otherwise(name)


def perf_map_name(name: Column) -> Column:
    """A method without its assembly, return type and signature, and with dots for colons."""
    plain = F.regexp_replace(F.regexp_replace(name, r"^\[[^\]]*\]\s*|\s*\[[^\]]*\]$", ""), r"\(.*$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^.*\s", ""), "::", ".")


def qualifier_and_member(name: Column) -> tuple[Column, Column]:
    """Parts a name at its last dot outside brackets."""
    member = F.regexp_extract(name, r"((?:[^.<\[(]|<.*>|\[.*\]|\(.*\))*)$", 1)
    return F.regexp_replace(F.left(name, F.length(name) - F.length(member)), r"\.$", ""), member


def _nested(name: str) -> str:
    if not name or not name.startswith("_ZN"):
        return name
    rest, parts = name[3:].lstrip("KVr"), []
    while rest and rest[0].isdigit():
        digits = len(rest) - len(rest.lstrip("0123456789"))
        size = int(rest[:digits])
        if digits + size > len(rest):
            return name
        parts.append(rest[digits : digits + size])
        rest = rest[digits + size :]
    return "::".join(parts) if parts and rest.startswith("E") else name


@F.pandas_udf(T.StringType())
def demangled(names: pd.Series) -> pd.Series:
    """Nested C++ names; other encodings stay as they are."""
    return names.map(_nested, na_action="ignore")
