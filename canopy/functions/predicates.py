"""When metadata counts as equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Side = Callable[[str], Column]


def mtime_matches(a: Side, b: Side) -> Column:
    """Whether the times are at most one second apart, inclusive.

    With nanoseconds below a second this needs no wide arithmetic, and no second overflows."""

    def next_second(x: Side, y: Side) -> Column:
        return x("mtime_sec").eqNullSafe(F.try_add(y("mtime_sec"), F.lit(1))) & (x("mtime_nsec") <= y("mtime_nsec"))

    return (a("mtime_sec") == b("mtime_sec")) | next_second(a, b) | next_second(b, a)


def metadata_matches(a: Side, b: Side) -> Column:
    same = mtime_matches(a, b)
    for c in ("size", "permissions", "uid", "gid"):
        same &= a(c) == b(c)
    return same


def hash_reusable(old: Side, new: Side) -> Column:
    """Same size and second: what a file's earlier hash is trusted on."""
    return (old("kind") == "file") & (new("kind") == "file") & old("hash").isNotNull() & (old("size") == new("size")) & (old("mtime_sec") == new("mtime_sec"))
