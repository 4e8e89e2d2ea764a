"""Queries over real trees in the shared folder: scans, record files, applying and verifying."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..engine import Engine
from ..operators import diff, merkle, verify
from . import fixtures as fx
from .registry import DRIFT_SQL, FINAL_SQL, IMPLICIT_SQL, REUSE_SQL, SHOWN, drifted, query, sides

ENTRY = ("path", "kind", "size", "mtime_sec", "permissions", "hash", "symlink_target")
ENTRY_SQL = "SELECT path, kind, CAST(size AS BIGINT) AS size, CAST(mtime_sec AS BIGINT) AS mtime_sec, CAST(permissions AS INT) AS permissions, hash, target AS symlink_target"


def on_disk(sql: str) -> str:
    """SQL of the trees as files have it: sizes are bytes, and links allow everything."""
    return sql.replace("n_chars AS size", "strlen(text) AS size").replace("CASE WHEN bkt = 2 THEN 493 ELSE 420 END AS permissions", "CASE bkt WHEN 2 THEN 493 WHEN 5 THEN 511 ELSE 420 END AS permissions")


def folder(spark: SparkSession) -> str:
    """A new folder where driver and executors see the same files."""
    path = storage.posix(storage.shared_dir(spark)) + f"/canopy-tree-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def plant(rows: DataFrame, text: DataFrame, root: str) -> str:
    """The files and links of a snapshot, written by tasks, then the few directories' modes and times."""
    leaves = rows.where("kind <> 'directory'").join(text, "path").select("path", "kind", "text", "mtime_sec", "permissions", "symlink_target")

    def run(batches):
        for b in batches:
            for path, kind, text, sec, mode, target in zip(*b.columns):
                full, sec = os.path.join(root, path.as_py()), sec.as_py()
                os.makedirs(os.path.dirname(full), exist_ok=True)
                if os.path.lexists(full):
                    os.unlink(full)
                if kind.as_py() == "symlink":
                    os.symlink(target.as_py(), full)
                else:
                    with open(full, "wb") as f:
                        f.write(text.as_buffer())
                    os.chmod(full, mode.as_py())
                os.utime(full, (sec, sec), follow_symlinks=False)
            yield b.select(["path"])

    storage.in_arrow(leaves, run, "path string").agg(F.count("path")).first()
    dirs = rows.where("kind = 'directory'").select("path", "permissions", "mtime_sec").orderBy(F.desc("path"))
    made = [tuple(r) for r in dirs.toLocalIterator()]
    for path, _, _ in made:
        os.makedirs(os.path.join(root, path), exist_ok=True)
    for path, mode, sec in made:
        full = os.path.join(root, path)
        os.chmod(full, mode)
        os.utime(full, (sec, sec))
    return root


def planted(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The old and the new tree of the documents, on disk."""
    old, new = sides(spark, sf_dir)
    text = fx.document_files(spark, sf_dir).select("path", F.when(F.col("bkt") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    before = fx.document_files(spark, sf_dir).select("path", "text")
    return plant(old, before, folder(spark)), plant(new, text, folder(spark))


def recorded(spark: SparkSession, sf_dir: str) -> tuple[Engine, str, str]:
    """An engine, the old tree, and a folder with record files: old and new snapshot, and a diff in compressed chunks."""
    engine = Engine(spark)
    old, new = planted(spark, sf_dir)
    out = folder(spark)
    engine.snapshot(old, f"{out}/old", compress=True, record_format=True)
    engine.diff(new, f"{out}/old", f"{out}/diff", f"{out}/new", split_size=4096, compress=True, record_format=True)
    return engine, old, out


@query(on_disk(f"WITH {fx.SQL} {ENTRY_SQL} FROM n"))
def tree_scan(spark, sf_dir):
    return Engine(spark).scan(planted(spark, sf_dir)[1]).select(*ENTRY)


@query(on_disk(f"WITH {fx.SQL} SELECT path FROM n WHERE starts_with(path, 'src1/')"))
def tree_scan_below(spark, sf_dir):
    Engine(spark)
    return spark.read.format("tree").option("root", planted(spark, sf_dir)[1]).option("hash", "none").load().where(F.col("path").startswith("src1/")).select("path")


@query(on_disk(REUSE_SQL + "SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'directory') AS directories, count(*) FILTER (kind = 'symlink') AS symlinks, count(*) FILTER (kind = 'file' AND NOT coalesce(hit, false)) AS hashed, count(*) FILTER (kind = 'file' AND hit) AS reused, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS total_entries, CAST(0 AS BIGINT) AS errors FROM w"))
def tree_snapshot_stats(spark, sf_dir):
    engine = Engine(spark)
    old, new = planted(spark, sf_dir)
    out = folder(spark)
    engine.snapshot(old, f"{out}/old")
    stats = engine.snapshot(new, f"{out}/new", f"{out}/old")
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in stats.items()])


@query(f"WITH {fx.SQL} {ENTRY_SQL}, CAST(0 AS INT) AS mtime_nsec, CAST(1000 AS BIGINT) AS uid, CAST(1000 AS BIGINT) AS gid FROM n")
def record_snapshot(spark, sf_dir):
    engine, path = Engine(spark), folder(spark) + "/snapshot"
    engine.save_snapshot(fx.documents_new(spark, sf_dir), path, record_format=True, compress=True)
    return engine.load_snapshot(path).select(*ENTRY, "mtime_nsec", "uid", "gid")


#: Records of modified entries carry no kinds.
@query(on_disk(f"WITH {fx.SQL}, {fx.SQL_CHANGES} SELECT * REPLACE (CASE WHEN op <> 'modified' THEN old_kind END AS old_kind, CASE WHEN op <> 'modified' THEN new_kind END AS new_kind) FROM ({FINAL_SQL})"))
def record_diff(spark, sf_dir):
    engine, _, out = recorded(spark, sf_dir)
    return engine.load_changes(f"{out}/diff").select(*SHOWN)


@query(on_disk(f"WITH {fx.SQL} SELECT n.path, n.kind, CAST(n.size AS BIGINT) AS size, CAST(CASE WHEN f.bkt = 3 THEN n.mtime_sec - 1 ELSE n.mtime_sec END AS BIGINT) AS mtime_sec, n.permissions, n.hash, n.target AS symlink_target FROM n LEFT JOIN f ON f.path = n.path"))
def tree_apply(spark, sf_dir):
    engine, old, out = recorded(spark, sf_dir)
    failed = engine.apply(old, f"{out}/diff")["errors"]
    if failed:
        raise RuntimeError(f"{len(failed)} changes failed, the first: {failed[0]}")
    return engine.scan(old).select(*ENTRY)


#: The old tree with the changes made, held against the old snapshot: all that the diff does shows.
@query(on_disk(f"""
WITH {fx.SQL}, {fx.SQL_CHANGES}, {IMPLICIT_SQL},
sim AS (SELECT n.path, n.kind, n.size, n.mtime_sec - CAST(coalesce(f.bkt, -1) = 3 AS INT) AS mtime_sec, n.permissions, n.hash, n.target FROM n LEFT JOIN f ON f.path = n.path),
v AS (SELECT coalesce(s.path, o.path) AS path, s.kind AS sk, o.kind AS ok, s.size <> o.size OR s.permissions <> o.permissions OR abs(s.mtime_sec - o.mtime_sec) > 1 AS meta, s.hash IS DISTINCT FROM o.hash AS hd, s.target IS DISTINCT FROM o.target AS td FROM sim s FULL JOIN o ON s.path = o.path)
SELECT path, 'extra' AS category FROM v WHERE ok IS NULL UNION ALL SELECT path, 'missing' FROM v WHERE sk IS NULL UNION ALL SELECT path, 'kind' FROM v WHERE sk <> ok
UNION ALL SELECT path, 'metadata' FROM v WHERE sk IS NOT NULL AND ok IS NOT NULL AND meta AND path NOT IN (SELECT path FROM implicit)
UNION ALL SELECT path, 'hash' FROM v WHERE sk IS NOT NULL AND ok IS NOT NULL AND hd UNION ALL SELECT path, 'symlink' FROM v WHERE sk IS NOT NULL AND ok IS NOT NULL AND td
"""))
def tree_verify(spark, sf_dir):
    engine, old, out = recorded(spark, sf_dir)
    return engine.verify(old, f"{out}/diff", f"{out}/old").select("path", "category")


#: In reference mode an equal directory hides what is below it, unless the changes touch it without naming it.
VERIFY_HASHES = fx.SQL_HASHES.replace("FROM o UNION ALL SELECT 'n'", "FROM sim UNION ALL SELECT 'n'").replace("h2.dh || c.rest", "coalesce(h2.dh, c.h, repeat('0', 32)) || c.rest")


@query(DRIFT_SQL.rstrip() + f", {VERIFY_HASHES} SELECT path, category FROM r WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.path NOT IN (SELECT path FROM implicit) AND (m.path = r.path OR {fx.SQL_ABOVE.format(m='m.path', p='r.path')}))")
def verify_reference_mode(spark, sf_dir):
    old, new = sides(spark, sf_dir)
    target = storage.save(merkle.with_dir_hashes(storage.save(new, "side")), "hashed")
    return verify.verify(storage.save(drifted(spark, sf_dir), "drifted"), storage.save(diff.changes(old, new), "changes"), target, "reference").select("path", "category")
