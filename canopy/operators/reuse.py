"""Reusing hashes of an earlier snapshot, and counts of a walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates
from ..schema import SNAPSHOT


def split_by_reuse(walked: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that have their hash or need none, files still to be hashed).

    Two tables rather than a CASE: a Python hash function would run for all rows of a CASE."""
    p = previous.where("kind = 'file' AND hash IS NOT NULL").select("path", F.struct("kind", "size", "mtime_sec", "hash").alias("p"))
    j = walked.join(p, "path", "left")
    hit = F.coalesce(predicates.hash_reusable(lambda c: F.col(f"p.{c}"), lambda c: F.col(c)), F.lit(False))
    j = j.withColumn("hit", hit)
    known = j.where("hit OR kind <> 'file'").withColumn("hash", F.when(F.col("hit"), F.col("p.hash"))).withColumnRenamed("hit", "reused")
    return known.drop("p"), j.where("NOT hit AND kind = 'file'").drop("p", "hit")


def with_hashes(walked: DataFrame, previous: DataFrame, content: DataFrame) -> DataFrame:
    """The snapshot with hashes, reused where size and second are unchanged, plus `reused`.

    content: path, content_hash, of which only files without a hit are looked up."""
    known, todo = split_by_reuse(walked, previous)
    fresh = todo.join(content.select("path", "content_hash"), "path").withColumn("hash", F.col("content_hash")).withColumn("reused", F.lit(False))
    columns = [c for c in SNAPSHOT.names] + ["reused"]
    return known.select(*columns).unionByName(fresh.select(*columns))


def stats(snapshot: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """Counts of a walk: entries seen, by kind, hashed, reused, and errors: rows of kind 'error', and
    rows of `walked` that the snapshot lacks."""
    reused = F.coalesce(F.col("reused"), F.lit(False)) if "reused" in snapshot.columns else F.lit(False)
    file = F.col("kind") == "file"
    out = snapshot.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(file).alias("files"),
        F.count_if(F.col("kind") == "directory").alias("directories"),
        F.count_if(F.col("kind") == "symlink").alias("symlinks"),
        F.count_if(file & F.col("hash").isNotNull() & ~reused).alias("hashed"),
        F.count_if(file & reused).alias("reused"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(F.col("kind") == "error").alias("unread"),
    )
    total = walked.count() if walked is not None else None
    seen = F.col("entries") if total is None else F.lit(total).cast("bigint")
    return out.withColumn("total_entries", seen).withColumn("errors", F.col("total_entries") - F.col("entries") + F.col("unread")).drop("entries", "unread")
