"""Comparing a snapshot with the one expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import predicates
from ..schema import METADATA
from . import merkle, simulate
from .diff import CARRIED, MODES

#: Lines that a discrepancy takes in a report: metadata also shows both sides.
LINES = {"metadata": 3}


def discrepancies(actual: DataFrame, target: DataFrame, implicit: DataFrame | None = None, mode: str = "strict") -> DataFrame:
    """path, category, detail; several may hold for a path.

    Directories in `implicit` (path) aren't held to the target's metadata."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    implicit = actual.where("false").select("path") if implicit is None else implicit.select("path")
    if mode == "reference":
        dirs = merkle.matched_dirs(actual, target).join(implicit, "path", "left_anti")
        dirs = storage.maybe_broadcast(storage.save(dirs, "matched"))
        actual, target = (merkle.pruned(x, dirs, itself=True) for x in (actual, target))
    a = actual.select("path", F.struct(*CARRIED).alias("a"))
    t = target.select("path", F.struct(*CARRIED).alias("t"))
    j = a.join(t, "path", "full").join(implicit.select("path", F.lit(True).alias("implicit")), "path", "left")
    got, want = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"t.{c}"))
    both = F.col("a").isNotNull() & F.col("t").isNotNull()

    def say(when, category, detail):
        return F.when(when, F.struct(F.lit(category).alias("category"), detail.alias("detail")))

    def show(side):
        return F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), side(c).cast("string")) for c in METADATA])

    found = F.array_compact(
        F.array(
            say(F.col("t").isNull(), "extra", got("kind")),
            say(F.col("a").isNull(), "missing", want("kind")),
            say(both & (got("kind") != want("kind")), "kind", F.concat(got("kind"), F.lit(" -> "), want("kind"))),
            say(both & F.col("implicit").isNull() & ~predicates.metadata_matches(got, want), "metadata", F.concat(show(got), F.lit(" -> "), show(want))),
            say(both & ~got("hash").eqNullSafe(want("hash")), "hash", F.concat(F.coalesce(got("hash"), F.lit("-")), F.lit(" -> "), F.coalesce(want("hash"), F.lit("-")))),
            say(both & ~got("symlink_target").eqNullSafe(want("symlink_target")), "symlink", F.concat(F.coalesce(got("symlink_target"), F.lit("-")), F.lit(" -> "), F.coalesce(want("symlink_target"), F.lit("-")))),
        )
    )
    return j.select("path", F.explode(found).alias("d")).select("path", "d.category", "d.detail")


def line_count(found: DataFrame) -> DataFrame:
    """One row, lines: how long the report is."""
    lines = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in LINES.items()], F.lit(1))
    return found.agg(F.coalesce(F.sum(lines), F.lit(0)).cast("long").alias("lines"))


def verify(current: DataFrame, changes: DataFrame, target: DataFrame, mode: str = "strict", algorithm: str = "md5") -> DataFrame:
    """Discrepancies between the target and what the changes would make of the current state."""
    after = simulate.apply_changes(current, changes)
    implicit = simulate.implicit_dirs(current, changes)
    if mode == "reference":
        after = merkle.with_dir_hashes(after, algorithm)
    return discrepancies(after, target, implicit, mode)
