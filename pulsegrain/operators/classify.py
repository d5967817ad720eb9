"""First-match rules: severities, tidy names and the frame that a wait is named after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frame_rules import LOCK_PREFIXES as LOCK_PREFIXES


def any_prefix(name: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | name.startswith(p), prefixes, F.lit(False))


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(otherwise))


def by_prefix(name: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    return first_match([(name.startswith(p), label) for p, label in rules], otherwise)


def first_other_frame(frames: Column, is_primitive, empty: str = "<no stack captured>", leaf_fallback: bool = True) -> Column:
    """The first frame, from the leaf on, that is no lock primitive; else the leaf."""
    other = F.get(F.filter(frames, lambda f: ~is_primitive(f)), 0)
    if not leaf_fallback:
        return other
    return F.coalesce(other, F.get(frames, 0), F.lit(empty))


def pause_severity(ms: Column) -> Column:
    return first_match([(ms > limit, label) for limit, label in ((200, "critical"), (100, "severe"), (50, "high"), (20, "medium"), (10, "low"))], "none")


def share_severity(percent: Column, total: Column, duration: Column) -> Column:
    return first_match([((percent >= 10) | (total > duration), "alert"), (percent >= 5, "warn")], "none")


def tidy_name(name: Column) -> Column:
    """Empty names are <unknown>; all unresolved addresses are one."""
    named = F.coalesce(F.nullif(name, F.lit("")), F.lit("<unknown>"))
    return F.when(named.startswith("<unresolved"), F.lit("<unresolved>")).otherwise(named)
