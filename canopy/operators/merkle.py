"""Directory hashes from the bottom up, and pruning of equal subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import hashing, paths

#: Text that stands for a child when its directory is hashed; fields can't run into each other,
#: as a name has no byte 1 before its end and the rest has a fixed order.
TOKEN = ("kind", "h", "permissions", "uid", "gid", "mtime_sec", "mtime_nsec", "size")


def _token():
    size = F.when(F.col("kind") == "file", F.col("size")).otherwise(F.lit(0))
    fields = [size if c == "size" else F.col(c) for c in TOKEN]
    return F.concat(F.col("name"), F.lit("\x01"), F.concat_ws("|", *[f.cast("string") for f in fields]))


def dir_hashes(snapshot: DataFrame, algorithm: str = "md5") -> DataFrame:
    """path, dir_hash of each directory: a digest over its children in the order of their names.

    Works from the deepest level to the root, one aggregation a level; the snapshot is written once,
    by depth, so that a level reads its own rows. All children of one directory meet in one task."""
    slim = snapshot.select(
        "path", "kind", "size", "mtime_sec", "mtime_nsec", "permissions", "uid", "gid",
        paths.parent(F.col("path")).alias("parent"), paths.base_name(F.col("path")).alias("name"),
        F.when(F.col("kind") == "symlink", hashing.target_hash(F.col("symlink_target"), algorithm)).when(F.col("kind") == "file", F.coalesce("hash", F.lit(hashing.NO_HASH))).alias("h"),
        paths.depth(F.col("path")).alias("depth"),
    )
    slim = storage.save(slim, "tree", by=("depth",))
    levels = sorted((r["depth"] for r in slim.where("kind = 'directory'").select("depth").distinct().collect()), reverse=True)
    empty = F.md5(F.lit("")) if algorithm == "md5" else F.lit(hashing.xxh3_hex(b""))
    done = None
    below = None
    for level in levels:
        children = slim.where(F.col("depth") == level + 1)
        if below is None:
            children = children.withColumn("h", F.coalesce("h", F.lit(hashing.NO_HASH)))
        else:
            children = children.join(below.select(F.col("path"), F.col("dir_hash").alias("dh")), "path", "left")
            children = children.withColumn("h", F.coalesce("h", "dh", F.lit(hashing.NO_HASH)))
        if algorithm == "md5":
            hashed = children.select("parent", "name", _token().alias("token")).groupBy("parent").agg(F.expr("md5(listagg(token) WITHIN GROUP (ORDER BY name))").alias("dir_hash"))
        else:
            fields = F.struct("name", "kind", "h", "permissions", "uid", "gid", "mtime_sec", "mtime_nsec", "size")
            hashed = children.groupBy("parent").agg(F.sort_array(F.collect_list(fields)).alias("c")).select("parent", hashing.xxh3_of_children("c").alias("dir_hash"))
        own = slim.where((F.col("depth") == level) & (F.col("kind") == "directory")).select("path")
        below = own.join(hashed.withColumnRenamed("parent", "path"), "path", "left").select("path", F.coalesce("dir_hash", empty).alias("dir_hash"))
        below = storage.save(below, f"level-{level}")
        done = below if done is None else done.unionByName(below)
    return done if done is not None else snapshot.where("false").select("path", "dir_hash")


def with_dir_hashes(snapshot: DataFrame, algorithm: str = "md5") -> DataFrame:
    """The snapshot with its dir_hash column filled for directories."""
    return snapshot.drop("dir_hash").join(dir_hashes(snapshot, algorithm), "path", "left").select(*snapshot.columns)


def matched_dirs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that are directories with the same hash on both sides."""
    side = lambda df: df.where("kind = 'directory' AND dir_hash IS NOT NULL").select("path", "dir_hash")
    return side(old).join(side(new), ["path", "dir_hash"]).select("path")


def below(rows: DataFrame, dirs: DataFrame, itself: bool) -> DataFrame:
    """Paths of rows that are below one of dirs, or are one of them if asked for.

    Each path is joined by its ancestors: equi-joins only, and no row is compared with all dirs."""
    up = rows.select("path", F.explode(paths.ancestors(F.col("path"), itself)).alias("above"))
    return up.join(dirs.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()


def pruned(rows: DataFrame, dirs: DataFrame, itself: bool) -> DataFrame:
    """rows without those below matched dirs."""
    return rows.join(below(rows, dirs, itself), "path", "left_anti")
