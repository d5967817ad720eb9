"""The reference queries over the driver's tables, with the SQL that must give the same rows."""

from . import events, frames, live, series, structure, threads  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
