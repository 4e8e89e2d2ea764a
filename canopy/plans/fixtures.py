"""Trees made from the test tables: an old and a new side whose difference is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHANGES, SNAPSHOT

BASE = 1_700_000_000
#: Documents of these sources change, by floor(doc_id / 20) % 10.
HOT = ("src1", "src7")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot_rows(df: DataFrame, **given) -> DataFrame:
    """df as snapshot rows; columns that are missing take the usual values."""
    usual = {"kind": F.lit("file"), "size": F.lit(0), "mtime_sec": F.lit(BASE), "mtime_nsec": F.lit(0), "permissions": F.lit(420), "uid": F.lit(1000), "gid": F.lit(1000), "hash": F.lit(None), "symlink_target": F.lit(None), "dir_hash": F.lit(None)} | given
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have and f.name not in given else usual[f.name]).cast(f.dataType).alias(f.name) for f in SNAPSHOT.fields])


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    return d.select(
        F.concat_ws("/", "source", "lang", name).alias("path"), F.col("n_chars").alias("size"), F.md5("text").alias("hash"), (F.lit(BASE) + F.col("doc_id")).alias("mtime_sec"),
        F.when(F.col("source").isin(*HOT), F.floor(F.col("doc_id") / 20) % 10).alias("bkt"), "text", "source", "lang", "doc_id",
    )


def document_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source", "lang").distinct()
    paths = d.select(F.explode(F.array(F.lit(""), F.col("source"), F.concat_ws("/", "source", "lang"))).alias("path")).distinct()
    return snapshot_rows(paths, kind=F.lit("directory"), permissions=F.lit(493))


def documents_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir).where("bkt IS NULL OR bkt <> 6")
    return snapshot_rows(files).unionByName(document_dirs(spark, sf_dir))


def documents_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = document_files(spark, sf_dir).where("bkt IS NULL OR bkt <> 0")
    b = F.coalesce("bkt", F.lit(-1))
    link, edited = b == 5, b == 1
    files = snapshot_rows(
        f,
        kind=F.when(link, "symlink").otherwise("file"),
        size=F.when(link, 0).otherwise(F.col("size") + edited.cast("int")),
        hash=F.when(edited, F.md5(F.concat("text", F.lit("!")))).when(~link, F.col("hash")),
        mtime_sec=F.col("mtime_sec") + F.when(edited, 10).when(b == 3, 1).when(b == 4, 2).otherwise(0),
        permissions=F.when(b == 2, 493).otherwise(420),
        symlink_target=F.when(link, "/dev/null"),
    )
    d = document_dirs(spark, sf_dir)
    dirs = snapshot_rows(d, permissions=F.when(F.col("path") == "src3", 448).otherwise(493), mtime_sec=F.col("mtime_sec") + F.when(F.startswith(F.col("path"), F.lit("src1/")), 100).otherwise(0))
    return files.unionByName(dirs)


def order_files(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Flat directories of orders. New: of 50, one is gone, one touched, one resized, one within tolerance."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 50
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = o.where(k != (1 if new else 0)).select(
        F.concat(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_"), F.lit("/o"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("path"),
        (cents + F.when((k == 2) & F.lit(new), 1).otherwise(0)).alias("size"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.when((k == 3) & F.lit(new), 5).when((k == 4) & F.lit(new), 1).otherwise(0)).alias("mtime_sec"),
        F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), cents.cast("string"))).alias("hash"),
    )
    return snapshot_rows(rows)


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by day: the last event of a path and day; an error removes, any other sets the size to its id."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    e = e.withColumn("batch", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint"))
    last = e.groupBy("path", "batch", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    gone = F.col("m.event_id") % 7 == 0
    first = last.groupBy("path").agg(F.min("batch").alias("first"))
    rows = last.join(first, "path")
    op = F.when(gone, "removed").when(F.col("batch") == F.col("first"), "added").otherwise("modified")
    given = {"path": F.col("path"), "op": op, "old_kind": F.when(op != "added", "file"), "new_kind": F.when(~gone, "file"), "has_content": F.lit(False), "new_size": F.when(~gone, F.col("m.event_id")), "new_mtime_sec": F.when(~gone, F.unix_seconds("m.ts")),
             "new_mtime_nsec": F.when(~gone, 0), "new_permissions": F.when(~gone, 420), "new_uid": F.when(~gone, 1000), "new_gid": F.when(~gone, 1000)}
    return rows.select("batch", *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGES.fields])


#: The same trees for DuckDB: o and n are the snapshots.
SQL = """
f AS (SELECT source || '/' || lang || '/doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path, n_chars AS size, md5(text) AS hash, 1700000000 + doc_id AS mtime_sec, text,
  CASE WHEN source IN ('src1', 'src7') THEN (doc_id // 20) % 10 ELSE -1 END AS bkt FROM documents),
dirs AS (SELECT '' AS path UNION SELECT source FROM documents UNION SELECT source || '/' || lang FROM documents),
o AS (SELECT path, 'file' AS kind, size, mtime_sec, 420 AS permissions, hash, CAST(NULL AS VARCHAR) AS target FROM f WHERE bkt <> 6
  UNION ALL SELECT path, 'directory', 0, 1700000000, 493, NULL, NULL FROM dirs),
n AS (SELECT path, CASE WHEN bkt = 5 THEN 'symlink' ELSE 'file' END AS kind, CASE bkt WHEN 5 THEN 0 WHEN 1 THEN size + 1 ELSE size END AS size,
  mtime_sec + CASE bkt WHEN 1 THEN 10 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS mtime_sec, CASE WHEN bkt = 2 THEN 493 ELSE 420 END AS permissions,
  CASE bkt WHEN 1 THEN md5(text || '!') WHEN 5 THEN NULL ELSE hash END AS hash, CASE WHEN bkt = 5 THEN '/dev/null' END AS target FROM f WHERE bkt <> 0
  UNION ALL SELECT path, 'directory', 0, 1700000000 + CASE WHEN path LIKE 'src1/%' THEN 100 ELSE 0 END, CASE WHEN path = 'src3' THEN 448 ELSE 493 END, NULL, NULL FROM dirs)
"""
#: Directory hashes of both sides, three levels unrolled, and the directories that agree.
SQL_HASHES = """
s AS (SELECT 'o' AS side, * FROM o UNION ALL SELECT 'n', * FROM n),
k AS (SELECT side, path, kind, regexp_replace(path, '^.*/', '') AS name, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, len(path) - len(replace(path, '/', '')) + CAST(path <> '' AS INT) AS depth,
  CASE kind WHEN 'file' THEN hash WHEN 'symlink' THEN md5(target) END AS h, '|' || permissions || '|1000|1000|' || mtime_sec || '|0|' || CASE WHEN kind = 'file' THEN size ELSE 0 END AS rest FROM s),
h2 AS (SELECT d.side, d.path, md5(coalesce(string_agg(c.name || chr(1) || c.kind || '|' || c.h || c.rest, '' ORDER BY c.name), '')) AS dh FROM k d LEFT JOIN k c ON c.side = d.side AND c.parent = d.path AND c.depth = 3 WHERE d.kind = 'directory' AND d.depth = 2 GROUP BY d.side, d.path),
h1 AS (SELECT d.side, d.path, md5(coalesce(string_agg(c.name || chr(1) || c.kind || '|' || h2.dh || c.rest, '' ORDER BY c.name), '')) AS dh FROM k d LEFT JOIN k c ON c.side = d.side AND c.parent = d.path AND c.depth = 2 LEFT JOIN h2 ON h2.side = c.side AND h2.path = c.path WHERE d.kind = 'directory' AND d.depth = 1 GROUP BY d.side, d.path),
h0 AS (SELECT c.side, '' AS path, md5(string_agg(c.name || chr(1) || c.kind || '|' || h1.dh || c.rest, '' ORDER BY c.name)) AS dh FROM k c JOIN h1 ON h1.side = c.side AND h1.path = c.path WHERE c.depth = 1 GROUP BY c.side),
hashes AS (SELECT * FROM h2 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h0),
matched AS (SELECT a.path FROM hashes a JOIN hashes b ON a.path = b.path AND a.dh = b.dh WHERE a.side = 'o' AND b.side = 'n')
"""
#: Changes between o and n. {prune}: a condition on path that holds for rows left out.
SQL_CHANGES = """
j AS (SELECT coalesce(o.path, n.path) AS path, o.kind AS ok, n.kind AS nk, o.size AS os, n.size AS ns, o.mtime_sec AS om, n.mtime_sec AS nm, o.permissions AS op, n.permissions AS np, o.hash AS oh, n.hash AS nh, o.target AS ot, n.target AS nt FROM o FULL JOIN n ON o.path = n.path),
e AS (SELECT *, os <> ns OR op <> np OR abs(om - nm) > 1 AS meta, oh IS DISTINCT FROM nh AS hd, ot IS DISTINCT FROM nt AS td FROM j),
c AS (SELECT path, 'removed' AS op, ok AS old_kind, CAST(NULL AS VARCHAR) AS new_kind, false AS has_content, CAST(NULL AS BIGINT) AS new_size, CAST(NULL AS BIGINT) AS new_mtime_sec, CAST(NULL AS INT) AS new_permissions, CAST(NULL AS VARCHAR) AS new_hash, CAST(NULL AS VARCHAR) AS new_symlink_target FROM e WHERE ok IS NOT NULL AND (nk IS NULL OR ok <> nk)
  UNION ALL SELECT path, 'added', NULL, nk, nk = 'file', ns, nm, np, nh, nt FROM e WHERE nk IS NOT NULL AND (ok IS NULL OR ok <> nk)
  UNION ALL SELECT path, 'modified', ok, nk, hd AND nk = 'file', CASE WHEN meta OR (hd AND nk = 'file') THEN ns END, CASE WHEN meta OR (hd AND nk = 'file') THEN nm END, CASE WHEN meta OR (hd AND nk = 'file') THEN np END, CASE WHEN hd THEN nh END, CASE WHEN td THEN nt END FROM e WHERE ok = nk AND (meta OR hd OR td))
"""
#: Paths above a path, as a join condition: m above p.
SQL_ABOVE = "({p} <> {m} AND ({m} = '' OR starts_with({p}, {m} || '/')))"
