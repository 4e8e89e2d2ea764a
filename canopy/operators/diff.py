"""Changes that turn one snapshot into another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..functions import paths, predicates
from ..schema import CHANGES, METADATA
from . import merkle

#: How equal directory hashes are used. "off": not at all. "strict": rows below an equal directory
#: are left out, the directory itself is compared; the result is that of "off". "reference": the
#: directory itself is left out too, so a change of its own metadata is lost.
MODES = ("strict", "reference", "off")
CARRIED = ("kind", *METADATA, "hash", "symlink_target")


def changes(old: DataFrame, new: DataFrame, mode: str = "strict", prune: bool = False) -> DataFrame:
    """One row for each change. A change of kind is two, removed then added.

    A full outer join on the path. In strict mode pruning can't alter the result and costs joins of
    its own, so it is done only if `prune` asks for it."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "reference" or (mode == "strict" and prune):
        dirs = storage.maybe_broadcast(storage.save(merkle.matched_dirs(old, new), "matched"))
        old, new = (merkle.pruned(x, dirs, itself=mode == "reference") for x in (old, new))
    o = old.select("path", F.struct(*CARRIED).alias("o"))
    n = new.select("path", F.struct(*CARRIED).alias("n"))
    j = o.join(n, "path", "full")
    before, after = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    meta = ~predicates.metadata_matches(before, after)
    hashed = ~before("hash").eqNullSafe(after("hash"))
    target = ~before("symlink_target").eqNullSafe(after("symlink_target"))
    ops = (
        F.when(F.col("n").isNull(), F.array(F.lit("removed")))
        .when(F.col("o").isNull(), F.array(F.lit("added")))
        .when(before("kind") != after("kind"), F.array(F.lit("removed"), F.lit("added")))
        .when(meta | hashed | target, F.array(F.lit("modified")))
    )
    j = j.where(F.col("o").isNull() | F.col("n").isNull() | (before("kind") != after("kind")) | meta | hashed | target).select("path", "o", "n", F.explode(ops).alias("op"))
    added, modified = F.col("op") == "added", F.col("op") == "modified"
    content = F.when(added, after("kind") == "file").when(modified, hashed & (after("kind") == "file")).otherwise(False)
    told = added | (modified & (meta | content))
    out = [
        "path", "op", F.when(~added, before("kind")).alias("old_kind"), F.when(added | modified, after("kind")).alias("new_kind"), content.alias("has_content"),
        *[F.when(told, after(c)).alias(f"new_{c}") for c in METADATA],
        F.when(added | (modified & hashed), after("hash")).alias("new_hash"),
        F.when(added | (modified & target), after("symlink_target")).alias("new_symlink_target"),
    ]
    return j.select(*out).select(*CHANGES.names)


def op_rank():
    return F.when(F.col("op") == "removed", 0).otherwise(1)


def with_sequence(rows: DataFrame) -> DataFrame:
    """rows with seq: their place by path, removals first."""
    return numbered(rows, [paths.components(F.col("path")), op_rank()], "seq")


def numbered(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """rows with their place, from 0, in the order of the keys. No task sees more than its range of keys."""
    own = [f"_key{i}" for i in range(len(keys))]
    parts = rows.withColumns(dict(zip(own, keys)))
    placed = storage.save(parts.repartitionByRange(*own).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = dict(placed.groupBy("_part").count().collect())
    start, starts = 0, {}
    for k in sorted(counts):
        starts[k] = start
        start += counts[k]
    offset = F.coalesce(*[F.when(F.col("_part") == k, F.lit(v).cast("long")) for k, v in starts.items()], F.lit(0).cast("long"))
    order = W.partitionBy("_part").orderBy(*own)
    return placed.withColumn(name, F.row_number().over(order) - 1 + offset).drop(*own, "_part")


def skipped(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of the new side that equal directory hashes leave out, directories included."""
    return merkle.below(new, storage.maybe_broadcast(storage.save(merkle.matched_dirs(old, new), "matched")), itself=True)


def summary(rows: DataFrame) -> DataFrame:
    """One row: added, modified, removed, with_content; a change of kind counts as added and as removed."""
    count = lambda c: F.count_if(c)
    return rows.agg(count(F.col("op") == "added").alias("added"), count(F.col("op") == "modified").alias("modified"), count(F.col("op") == "removed").alias("removed"), count(F.col("has_content")).alias("with_content"))


def content_manifest(rows: DataFrame) -> DataFrame:
    """path, expected size and hash of each file whose content a change carries."""
    return rows.where("has_content").select("path", F.col("new_size").alias("size"), F.col("new_hash").alias("hash"))
