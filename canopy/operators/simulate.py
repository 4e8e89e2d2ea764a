"""Applying changes to a snapshot as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import METADATA, SNAPSHOT


def reduced(changes: DataFrame) -> DataFrame:
    """One row a path: its last removal or addition, and what modifications after that set.

    With a seq column changes hold in that order; without, a removal precedes an addition."""
    seq = F.col("seq") if "seq" in changes.columns else F.when(F.col("op") == "removed", 0).otherwise(1).cast("long")
    meta = F.struct(*[F.col(f"new_{c}").alias(c) for c in METADATA])
    rows = changes.select(
        "path",
        F.when(F.col("op") != "modified", F.struct(seq.alias("seq"), F.col("op"), F.col("new_kind").alias("kind"), meta.alias("meta"), F.col("new_hash").alias("hash"), F.col("new_symlink_target").alias("target"))).alias("reset"),
        F.when((F.col("op") == "modified") & F.col("new_size").isNotNull(), F.struct(seq.alias("seq"), meta.alias("meta"))).alias("meta"),
        F.when((F.col("op") == "modified") & F.col("new_hash").isNotNull(), F.struct(seq.alias("seq"), F.col("new_hash").alias("hash"))).alias("hash"),
        F.when((F.col("op") == "modified") & F.col("new_symlink_target").isNotNull(), F.struct(seq.alias("seq"), F.col("new_symlink_target").alias("target"))).alias("target"),
    )
    out = rows.groupBy("path").agg(*[F.max(c).alias(c) for c in ("reset", "meta", "hash", "target")])
    late = lambda c: F.when(F.col("reset").isNull() | (F.col(f"{c}.seq") > F.col("reset.seq")), F.col(f"{c}.{c}"))
    return out.select("path", "reset", late("meta").alias("meta"), late("hash").alias("hash"), late("target").alias("target"))


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after the changes: removals take single paths, additions replace, modifications
    overlay what they set, and do nothing where the path is absent. Directory hashes are left null."""
    r = reduced(changes).select("path", F.struct("reset", "meta", "hash", "target").alias("c"))
    s = state.select("path", F.struct("kind", F.struct(*METADATA).alias("meta"), "hash", F.col("symlink_target").alias("target")).alias("s"))
    j = s.join(r, "path", "full")
    fresh = F.col("c.reset").isNotNull()
    gone = fresh & (F.col("c.reset.op") == "removed")
    absent = ~fresh & F.col("s").isNull()
    j = j.where(~F.coalesce(gone, F.lit(False)) & ~F.coalesce(absent, F.lit(False)))
    base = lambda name: F.when(fresh, F.col(f"c.reset.{name}")).otherwise(F.col(f"s.{name}"))
    j = j.select("path", base("kind").alias("kind"), F.coalesce("c.meta", base("meta")).alias("m"), F.coalesce("c.hash", base("hash")).alias("hash"), F.coalesce("c.target", base("target")).alias("symlink_target"))
    return j.select("path", "kind", *[F.col(f"m.{c}").alias(c) for c in METADATA], "hash", "symlink_target", F.lit(None).cast("string").alias("dir_hash")).select(*SNAPSHOT.names)


def affected_parents(changes: DataFrame) -> DataFrame:
    return changes.select(paths.parent(F.col("path")).alias("path")).where("path IS NOT NULL").distinct()


def explicit_dirs(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Directories whose metadata the changes set themselves; state is that before the changes."""
    added = changes.where("op = 'added' AND new_kind = 'directory'").select("path")
    touched = changes.where("op = 'modified' AND new_size IS NOT NULL").select("path")
    return added.union(touched.join(state.where("kind = 'directory'"), "path", "left_semi")).distinct()


def implicit_dirs(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Parents of changed paths that no change sets: applying keeps their times."""
    return affected_parents(changes).join(explicit_dirs(state, changes), "path", "left_anti")
