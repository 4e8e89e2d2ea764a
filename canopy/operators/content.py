"""Content of files as fragments, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing


def fragments(content: DataFrame, plan: DataFrame) -> DataFrame:
    """CONTENT rows: path, bytes cut as the plan (path, chunk_index, frag_no, offset, length) says.

    A file's bytes are shuffled once, and then cut where they are. Files larger than a cell can be
    are read in pieces by sources.tree.contents instead."""
    cuts = plan.groupBy("path").agg(F.collect_list(F.struct("chunk_index", "frag_no", "offset", "length")).alias("cuts"))
    cut = lambda c: F.substring(F.col("bytes"), c["offset"].cast("int") + 1, c["length"].cast("int"))
    pieces = F.transform("cuts", lambda c: F.struct(c["chunk_index"].alias("chunk_index"), c["frag_no"].alias("frag_no"), c["offset"].alias("offset"), c["length"].alias("length"), cut(c).alias("bytes")))
    return cuts.join(content.select("path", "bytes"), "path").select("path", F.inline(pieces))


def reassembled(pieces: DataFrame) -> DataFrame:
    """path, bytes, size: a file's fragments in the order of their offsets, whatever order they came in.

    Each file becomes one cell, so this is for files below 2 GB; digests() has no such limit."""
    whole = F.expr("listagg(bytes) WITHIN GROUP (ORDER BY struct(offset, frag_no))")
    return pieces.groupBy("path").agg(F.coalesce(whole, F.lit(b"")).alias("bytes")).withColumn("size", F.length("bytes").cast("bigint"))


def digests(pieces: DataFrame, algorithm: str = "md5") -> DataFrame:
    """path, total, whole, hash: each file's bytes hashed as they stream by, sorted by offset.

    whole is false if the fragments leave gaps or overlap. No file is held, whatever its length."""
    rows = pieces.select("path", "offset", "frag_no", "bytes").repartition("path").sortWithinPartitions("path", "offset", "frag_no")

    def run(batches):
        import pandas as pd

        path = digest = None
        total, whole, done = 0, True, []
        for b in batches:
            for r in b.itertuples(index=False):
                if r.path != path:
                    if digest is not None:
                        done.append((path, total, whole, hashing.digest_hex(digest, algorithm)))
                    path, digest, total, whole = r.path, hashing.new_digest(algorithm), 0, True
                whole = whole and r.offset == total
                digest.update(r.bytes)
                total += len(r.bytes)
            if len(done) > 1000:
                yield pd.DataFrame(done, columns=["path", "total", "whole", "hash"])
                done = []
        if digest is not None:
            done.append((path, total, whole, hashing.digest_hex(digest, algorithm)))
        yield pd.DataFrame(done, columns=["path", "total", "whole", "hash"])

    return rows.mapInPandas(run, "path string, total bigint, whole boolean, hash string")


def broken(pieces: DataFrame, manifest: DataFrame, algorithm: str = "md5") -> DataFrame:
    """path, problem: files of the manifest (path, size, hash) whose fragments are missing, leave gaps
    or overlap, have another length, or another hash."""
    got = digests(pieces, algorithm).withColumnRenamed("hash", "got")
    problem = (
        F.when(F.col("total").isNull(), "missing")
        .when((F.col("total") != F.col("size")) | ~F.col("whole"), "length")
        .when(F.col("hash").isNotNull() & (F.col("got") != F.col("hash")), "hash")
    )
    return manifest.join(got, "path", "left").select("path", problem.alias("problem")).where("problem IS NOT NULL")
