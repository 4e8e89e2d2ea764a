"""Queries over the test tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import hashing, paths, predicates, sizes
from ..operators import content, diff, merkle, reuse, simulate, split, verify
from ..streaming import sync
from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SHOWN = ("path", "op", "old_kind", "new_kind", "has_content", "new_size", "new_mtime_sec", "new_permissions", "new_hash", "new_symlink_target")
FINAL_SQL = "SELECT path, op, old_kind, new_kind, has_content, CAST(new_size AS BIGINT) AS new_size, CAST(new_mtime_sec AS BIGINT) AS new_mtime_sec, CAST(new_permissions AS INT) AS new_permissions, new_hash, new_symlink_target FROM c"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.documents_old(spark, sf_dir), fx.documents_new(spark, sf_dir)


def hashed_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with directory hashes. Written first: the tree is read level by level."""
    return tuple(storage.save(merkle.with_dir_hashes(storage.save(x, "side")), "hashed") for x in sides(spark, sf_dir))


# Snapshots


@query(f"WITH {fx.SQL} SELECT path, kind, CAST(size AS BIGINT) AS size, CAST(mtime_sec AS BIGINT) AS mtime_sec, permissions, hash, target AS symlink_target, CAST(len(path) - len(replace(path, '/', '')) + CAST(path <> '' AS INT) AS INT) AS depth, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_replace(path, '^.*/', '') AS name FROM n")
def snapshot_documents(spark, sf_dir):
    p = F.col("path")
    return fx.documents_new(spark, sf_dir).select("path", "kind", "size", "mtime_sec", "permissions", "hash", "symlink_target", paths.depth(p).alias("depth"), paths.parent(p).alias("parent"), paths.base_name(p).alias("name"))


@query(f"WITH {fx.SQL} SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'directory') AS directories, count(*) FILTER (kind = 'symlink') AS symlinks, count(*) FILTER (kind = 'file' AND hash IS NOT NULL) AS hashed, CAST(0 AS BIGINT) AS reused, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS total_entries, CAST(0 AS BIGINT) AS errors FROM n")
def snapshot_stats(spark, sf_dir):
    return reuse.stats(fx.documents_new(spark, sf_dir))


@query("""
WITH p AS (SELECT page_id, './' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS raw FROM pages),
c AS (SELECT page_id, raw, list_filter(string_split(raw, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM p)
SELECT page_id, array_to_string(parts, '/') AS path, CAST(len(parts) AS INT) AS depth, array_to_string(parts[1:len(parts) - 1], '/') AS parent, parts[len(parts)] AS name,
  '/srv/' || array_to_string(parts, '/') AS full_path, CAST(len(parts) AS INT) AS n_above, len(parts) > 1 AS in_host, array_to_string(parts, '/') AS stripped FROM c
""")
def path_functions(spark, sf_dir):
    d = fx.read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("./"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")).alias("raw"))
    d = d.select("page_id", paths.normalize(F.col("raw")).alias("path"))
    p = F.col("path")
    return d.select(
        "page_id", "path", paths.depth(p).alias("depth"), paths.parent(p).alias("parent"), paths.base_name(p).alias("name"), paths.full_path(F.lit("/srv"), p).alias("full_path"),
        F.size(paths.ancestors(p, False)).alias("n_above"), paths.contains(F.substring_index(p, "/", 1), p).alias("in_host"), paths.strip_root(paths.full_path(F.lit("/srv"), p), "/srv").alias("stripped"),
    )


@query(f"WITH {fx.SQL} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS seq, 'added' AS op FROM n WHERE path <> ''")
def component_order(spark, sf_dir):
    rows = fx.documents_new(spark, sf_dir).where("path <> ''").select("path", F.lit("added").alias("op"))
    return diff.with_sequence(rows).select("path", "seq", "op")


@query(f"WITH {fx.SQL}, x AS (SELECT path, len(path) - len(replace(path, '/', '')) + CAST(path <> '' AS INT) AS depth FROM n WHERE kind = 'directory') SELECT path, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY depth DESC, path) AS deep_first, row_number() OVER (ORDER BY depth, path) AS shallow_first FROM x")
def depth_order(spark, sf_dir):
    d = fx.document_dirs(spark, sf_dir).select("path", paths.depth(F.col("path")).alias("depth"))
    for name, depth in (("deep_first", -F.col("depth")), ("shallow_first", F.col("depth"))):
        d = diff.numbered(d, [depth, F.col("path")], name).withColumn(name, F.col(name) + 1)
    return d


@query("SELECT doc_id, md5(text) AS content_hash, lower(hex(substr(lang, 1, 2)::BLOB)) AS lang_hex, md5(source) AS target_hash, '00000000000000000000000000000000' AS no_target FROM documents")
def content_hashes(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents")
    return d.select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"), hashing.hex_lower(F.substring("lang", 1, 2).cast("binary")).alias("lang_hex"), hashing.target_hash(F.col("source")).alias("target_hash"), hashing.target_hash(F.lit(None).cast("string")).alias("no_target"))


@query()
def content_hashes_xxh3(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents")
    return d.select("doc_id", hashing.content_hash(F.col("text").cast("binary"), "xxh3").alias("content_hash"))


# Directory hashes


@query(f"WITH {fx.SQL}, {fx.SQL_HASHES} SELECT path, dh AS dir_hash FROM hashes WHERE side = 'n'")
def dir_hash_levels(spark, sf_dir):
    return merkle.dir_hashes(fx.documents_new(spark, sf_dir))


@query()
def dir_hash_xxh3(spark, sf_dir):
    return merkle.dir_hashes(fx.documents_new(spark, sf_dir), "xxh3")


@query(f"WITH {fx.SQL}, {fx.SQL_HASHES} SELECT path FROM matched")
def matched_directories(spark, sf_dir):
    return merkle.matched_dirs(*hashed_sides(spark, sf_dir))


# Diff


@query(f"WITH {fx.SQL}, {fx.SQL_CHANGES} {FINAL_SQL}")
def diff_full(spark, sf_dir):
    return diff.changes(*sides(spark, sf_dir), mode="off").select(*SHOWN)


@query(f"WITH {fx.SQL}, {fx.SQL_HASHES}, {fx.SQL_CHANGES} {FINAL_SQL} WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.path = c.path OR {fx.SQL_ABOVE.format(m='m.path', p='c.path')})")
def diff_merkle_reference(spark, sf_dir):
    return diff.changes(*hashed_sides(spark, sf_dir), mode="reference").select(*SHOWN)


@query(f"WITH {fx.SQL}, {fx.SQL_HASHES}, {fx.SQL_CHANGES} {FINAL_SQL} WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE {fx.SQL_ABOVE.format(m='m.path', p='c.path')})")
def diff_merkle_strict(spark, sf_dir):
    return diff.changes(*hashed_sides(spark, sf_dir), mode="strict", prune=True).select(*SHOWN)


@query(f"WITH {fx.SQL}, {fx.SQL_CHANGES} SELECT count(*) FILTER (op = 'added') AS added, count(*) FILTER (op = 'modified') AS modified, count(*) FILTER (op = 'removed') AS removed, count(*) FILTER (has_content) AS with_content FROM c")
def diff_summary(spark, sf_dir):
    return diff.summary(diff.changes(*sides(spark, sf_dir)))


@query(f"WITH {fx.SQL}, {fx.SQL_HASHES} SELECT path FROM n WHERE EXISTS (SELECT 1 FROM matched m WHERE m.path = n.path OR {fx.SQL_ABOVE.format(m='m.path', p='n.path')})")
def diff_skipped(spark, sf_dir):
    return diff.skipped(*hashed_sides(spark, sf_dir))


@query(f"WITH {fx.SQL}, {fx.SQL_CHANGES} {FINAL_SQL} WHERE path IN (SELECT path FROM e WHERE ok <> nk)")
def kind_change(spark, sf_dir):
    rows = diff.changes(*sides(spark, sf_dir))
    twice = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return rows.join(twice, "path", "left_semi").select(*SHOWN)


ORDERS_SQL = """
b AS (SELECT regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g') || '/o' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS path, o_orderkey % 50 AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(epoch(o_orderdate) AS BIGINT) AS t, o_orderkey, o_orderstatus FROM orders),
o AS (SELECT path, 'file' AS kind, cents AS size, t AS mtime_sec, 420 AS permissions, md5(o_orderkey || '|' || o_orderstatus || '|' || cents) AS hash, CAST(NULL AS VARCHAR) AS target FROM b WHERE k <> 0),
n AS (SELECT path, 'file' AS kind, cents + CAST(k = 2 AS INT) AS size, t + CASE k WHEN 3 THEN 5 WHEN 4 THEN 1 ELSE 0 END AS mtime_sec, 420 AS permissions, md5(o_orderkey || '|' || o_orderstatus || '|' || cents) AS hash, CAST(NULL AS VARCHAR) AS target FROM b WHERE k <> 1)
"""


@query(f"WITH {ORDERS_SQL}, {fx.SQL_CHANGES} {FINAL_SQL}")
def diff_orders(spark, sf_dir):
    return diff.changes(fx.order_files(spark, sf_dir, False), fx.order_files(spark, sf_dir, True)).select(*SHOWN)


@query(f"WITH {fx.SQL}, {fx.SQL_CHANGES} SELECT path, CAST(new_size AS BIGINT) AS size, new_hash AS hash FROM c WHERE has_content")
def content_manifest(spark, sf_dir):
    return diff.content_manifest(diff.changes(*sides(spark, sf_dir)))


# Predicates


@query("""
WITH p AS (SELECT o_orderkey, o_orderkey % 9 AS k FROM orders),
t AS (SELECT o_orderkey, CAST(o_orderkey - 20000 AS HUGEINT) AS s1, CAST((o_orderkey * 7919) % 1000000000 AS HUGEINT) AS n1, k FROM p),
u AS (SELECT o_orderkey, s1, n1, s1 + CASE WHEN k < 3 THEN 1 WHEN k < 6 THEN -1 WHEN k = 6 THEN 0 WHEN k = 7 THEN 2 ELSE -2 END AS s2, CASE k % 3 WHEN 0 THEN n1 WHEN 1 THEN (n1 + 1) % 1000000000 ELSE (n1 + 999999999) % 1000000000 END AS n2 FROM t)
SELECT o_orderkey, abs(s1 * 1000000000 + n1 - s2 * 1000000000 - n2) <= 1000000000 AS same FROM u
""")
def mtime_tolerance(spark, sf_dir):
    k = F.col("o_orderkey") % 9
    t = fx.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") - 20000).alias("s1"), (F.col("o_orderkey") * 7919 % 1_000_000_000).alias("n1"), k.alias("k"))
    n = 1_000_000_000
    step = F.when(F.col("k") < 3, 1).when(F.col("k") < 6, -1).when(F.col("k") == 6, 0).when(F.col("k") == 7, 2).otherwise(-2)
    u = t.select("o_orderkey", F.struct(F.col("s1").alias("mtime_sec"), F.col("n1").alias("mtime_nsec")).alias("a"), F.struct((F.col("s1") + step).alias("mtime_sec"), F.when(F.col("k") % 3 == 0, F.col("n1")).when(F.col("k") % 3 == 1, (F.col("n1") + 1) % n).otherwise((F.col("n1") + n - 1) % n).alias("mtime_nsec")).alias("b"))
    return u.select("o_orderkey", predicates.mtime_matches(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")).alias("same"))


@query("""
WITH s AS (SELECT doc_id, CAST(n_chars AS VARCHAR) || CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'B' WHEN 2 THEN ' kb' WHEN 3 THEN 'M' WHEN 4 THEN 'gb ' WHEN 5 THEN 'KiB' WHEN 6 THEN '.5GB' ELSE 'K' END AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 8 IN (5, 6) THEN NULL ELSE CAST(CAST(regexp_extract(t, '[0-9]+') AS BIGINT) * CASE doc_id % 8 WHEN 2 THEN 1024 WHEN 7 THEN 1024 WHEN 3 THEN 1048576 WHEN 4 THEN 1073741824 ELSE 1 END AS BIGINT) END AS bytes FROM s
""")
def byte_size_parse(spark, sf_dir):
    k = F.col("doc_id") % 8
    unit = F.when(k == 0, "").when(k == 1, "B").when(k == 2, " kb").when(k == 3, "M").when(k == 4, "gb ").when(k == 5, "KiB").when(k == 6, ".5GB").otherwise("K")
    d = fx.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("n_chars").cast("string"), unit).alias("t"))
    return d.select("doc_id", sizes.size_column(F.col("t")).cast("bigint").alias("bytes"))


# Hash reuse, simulation, verification

REUSE_SQL = f"""
WITH {fx.SQL}, w AS (SELECT n.*, o.kind = 'file' AND n.kind = 'file' AND o.hash IS NOT NULL AND o.size = n.size AND o.mtime_sec = n.mtime_sec AS hit, o.hash AS old_hash FROM n LEFT JOIN o ON o.path = n.path)
"""


@query(REUSE_SQL + "SELECT path, kind, CASE WHEN coalesce(hit, false) THEN old_hash ELSE hash END AS hash, coalesce(hit, false) AS reused FROM w")
def hash_reuse(spark, sf_dir):
    old, new = sides(spark, sf_dir)
    fresh = new.where("kind = 'file'").select("path", F.col("hash").alias("content_hash"))
    return reuse.with_hashes(new.withColumn("hash", F.lit(None).cast("string")), old, fresh).select("path", "kind", "hash", "reused")


@query(REUSE_SQL + "SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'directory') AS directories, count(*) FILTER (kind = 'symlink') AS symlinks, count(*) FILTER (kind = 'file' AND NOT coalesce(hit, false)) AS hashed, count(*) FILTER (kind = 'file' AND hit) AS reused, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS total_entries, CAST(0 AS BIGINT) AS errors FROM w")
def hash_reuse_stats(spark, sf_dir):
    old, new = sides(spark, sf_dir)
    fresh = new.where("kind = 'file'").select("path", F.col("hash").alias("content_hash"))
    return reuse.stats(reuse.with_hashes(new.withColumn("hash", F.lit(None).cast("string")), old, fresh))


IMPLICIT_SQL = """
up AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS path FROM c WHERE path <> ''),
explicit AS (SELECT path FROM c WHERE op = 'added' AND new_kind = 'directory' UNION SELECT c.path FROM c JOIN o ON o.path = c.path AND o.kind = 'directory' WHERE c.op = 'modified' AND c.new_size IS NOT NULL),
implicit AS (SELECT path FROM up WHERE path NOT IN (SELECT path FROM explicit))
"""


@query(f"WITH {fx.SQL}, {fx.SQL_CHANGES}, {IMPLICIT_SQL} SELECT path FROM implicit")
def implicit_dirs(spark, sf_dir):
    old, new = sides(spark, sf_dir)
    return simulate.implicit_dirs(old, diff.changes(old, new))


#: After the changes everything is new's, but for times within tolerance, which stay.
@query(f"WITH {fx.SQL} SELECT n.path, n.kind, CAST(n.size AS BIGINT) AS size, CAST(CASE WHEN f.bkt = 3 THEN n.mtime_sec - 1 ELSE n.mtime_sec END AS BIGINT) AS mtime_sec, n.permissions, n.hash, n.target AS symlink_target FROM n LEFT JOIN f ON f.path = n.path")
def simulate_apply(spark, sf_dir):
    old, new = sides(spark, sf_dir)
    return simulate.apply_changes(old, diff.changes(old, new)).select("path", "kind", "size", "mtime_sec", "permissions", "hash", "symlink_target")


@query("SELECT '' AS path, '' AS category WHERE false")
def verify_clean(spark, sf_dir):
    old, new = sides(spark, sf_dir)
    return verify.verify(old, diff.changes(old, new), new).select("path", "category")


def drifted(spark, sf_dir):
    """The old tree after a drift: some files gone, some edited in place, one file too many, and directories touched."""
    old = fx.documents_old(spark, sf_dir)
    k = F.when(F.col("kind") == "file", (F.col("mtime_sec") - fx.BASE) % 40)
    d = old.withColumn("k", k).where("k IS NULL OR k <> 7")
    d = d.withColumn("hash", F.when(F.col("k") == 8, F.md5(F.concat("hash", F.lit("x")))).otherwise(F.col("hash"))).withColumn("permissions", F.when(F.col("k").isin(8, 9), 384).otherwise(F.col("permissions")))
    d = d.withColumn("mtime_sec", F.col("mtime_sec") + F.when(F.col("path").isin("src1", "src7", "src9"), 50).otherwise(0)).drop("k")
    extra = fx.snapshot_rows(old.where("path = 'src2'").select(F.lit("src2/stray").alias("path")))
    return d.unionByName(extra)


DRIFT_SQL = f"""
WITH {fx.SQL}, {fx.SQL_CHANGES}, {IMPLICIT_SQL},
x AS (SELECT o.*, CASE WHEN kind = 'file' THEN (mtime_sec - 1700000000) % 40 ELSE -1 END AS k FROM o),
cur AS (SELECT path, kind, size, mtime_sec + CASE WHEN path IN ('src1', 'src7', 'src9') THEN 50 ELSE 0 END AS mtime_sec, CASE WHEN k IN (8, 9) THEN 384 ELSE permissions END AS permissions, CASE WHEN k = 8 THEN md5(hash || 'x') ELSE hash END AS hash, target FROM x WHERE k <> 7
  UNION ALL SELECT 'src2/stray', 'file', 0, 1700000000, 420, NULL, NULL),
fresh AS (SELECT * FROM c WHERE op = 'added'), mods AS (SELECT * FROM c WHERE op = 'modified'),
sim AS (SELECT path, new_kind AS kind, new_size AS size, new_mtime_sec AS mtime_sec, new_permissions AS permissions, new_hash AS hash, new_symlink_target AS target FROM fresh
  UNION ALL SELECT cur.path, cur.kind, coalesce(m.new_size, cur.size), coalesce(m.new_mtime_sec, cur.mtime_sec), coalesce(m.new_permissions, cur.permissions), coalesce(m.new_hash, cur.hash), coalesce(m.new_symlink_target, cur.target)
  FROM cur LEFT JOIN mods m ON m.path = cur.path WHERE cur.path NOT IN (SELECT path FROM c WHERE op IN ('removed', 'added'))),
v AS (SELECT coalesce(s.path, n.path) AS path, s.kind AS sk, n.kind AS nk, s.size <> n.size OR s.permissions <> n.permissions OR abs(s.mtime_sec - n.mtime_sec) > 1 AS meta, s.hash IS DISTINCT FROM n.hash AS hd, s.target IS DISTINCT FROM n.target AS td FROM sim s FULL JOIN n ON s.path = n.path),
r AS (SELECT path, 'extra' AS category FROM v WHERE nk IS NULL UNION ALL SELECT path, 'missing' FROM v WHERE sk IS NULL UNION ALL SELECT path, 'kind' FROM v WHERE sk <> nk
  UNION ALL SELECT path, 'metadata' FROM v WHERE sk IS NOT NULL AND nk IS NOT NULL AND meta AND path NOT IN (SELECT path FROM implicit)
  UNION ALL SELECT path, 'hash' FROM v WHERE sk IS NOT NULL AND nk IS NOT NULL AND hd UNION ALL SELECT path, 'symlink' FROM v WHERE sk IS NOT NULL AND nk IS NOT NULL AND td)
"""


@query(DRIFT_SQL + "SELECT path, category FROM r")
def verify_discrepancies(spark, sf_dir):
    old, new = sides(spark, sf_dir)
    return verify.verify(drifted(spark, sf_dir), diff.changes(old, new), new).select("path", "category")


@query(DRIFT_SQL + "SELECT CAST(coalesce(sum(CASE category WHEN 'metadata' THEN 3 ELSE 1 END), 0) AS BIGINT) AS lines FROM r")
def verify_line_count(spark, sf_dir):
    old, new = sides(spark, sf_dir)
    return verify.line_count(verify.verify(drifted(spark, sf_dir), diff.changes(old, new), new))


# Transport

HEADER, LIMIT = 60, 20_000


def sized_changes(spark, sf_dir) -> DataFrame:
    rows = diff.with_sequence(diff.changes(*sides(spark, sf_dir)))
    return rows.select("path", "seq", (F.lit(100) + F.length("path")).cast("bigint").alias("record_bytes"), F.when(F.col("has_content"), F.col("new_size")).alias("content_bytes"))


#: A step of the recursion writes a record or a piece of content, or opens the next file. Content follows the last record.
PLAN_SQL = f"""
WITH RECURSIVE {fx.SQL}, {fx.SQL_CHANGES},
q AS (SELECT path, 100 + len(path) AS rb, CASE WHEN has_content THEN new_size END AS cb, row_number() OVER (ORDER BY string_split(path, '/'), op <> 'removed') - 1 AS seq FROM c),
items AS (SELECT row_number() OVER (ORDER BY g, seq) AS i, g, seq, size FROM (SELECT 0 AS g, seq, rb AS size FROM q UNION ALL SELECT 1, seq, cb FROM q WHERE cb IS NOT NULL)),
steps AS (
  SELECT CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS frag, CAST(1 AS BIGINT) AS chunk, CAST({HEADER} AS BIGINT) AS written, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS o, CAST(NULL AS BIGINT) AS len
  UNION ALL
  SELECT CASE WHEN nofit THEN i ELSE CASE WHEN g = 0 OR off + n >= size THEN i + 1 ELSE i END END, CASE WHEN nofit THEN off WHEN g = 0 OR off + n >= size THEN 0 ELSE off + n END, CASE WHEN nofit THEN frag WHEN g = 0 OR off + n >= size THEN 0 ELSE frag + 1 END,
    CASE WHEN nofit THEN chunk + 1 ELSE chunk END, CASE WHEN nofit THEN {HEADER} ELSE written + n + 9 * g END, CASE WHEN nofit THEN NULL WHEN g = 0 THEN 'change' ELSE 'content' END, seq, frag, off, n
  FROM (SELECT s.i, s.off, s.frag, s.chunk, s.written, x.g, x.seq, x.size, CASE WHEN x.g = 0 THEN s.written >= {LIMIT} ELSE s.written + 9 >= {LIMIT} END AS nofit, CASE WHEN x.g = 0 THEN x.size ELSE least(x.size - s.off, {LIMIT} - s.written - 9) END AS n FROM steps s JOIN items x ON x.i = s.i))
SELECT CAST(chunk AS INT) AS chunk_index, item, CAST(seq AS BIGINT) AS seq, CAST(f AS INT) AS frag_no, CAST(o AS BIGINT) AS "offset", CAST(len AS BIGINT) AS length FROM steps WHERE item IS NOT NULL
"""


@query(PLAN_SQL)
def split_plan(spark, sf_dir):
    return split.split_plan(sized_changes(spark, sf_dir), HEADER, LIMIT)


@query("SELECT count(DISTINCT doc_id // 100 + 1) AS n_chunks, CAST(max(doc_id // 100 + 1) - count(DISTINCT doc_id // 100 + 1) AS BIGINT) AS n_missing FROM documents WHERE doc_id // 100 NOT IN (1, 2)")
def chunk_gap_check(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 100) + 1).alias("chunk_index")).where("chunk_index NOT IN (2, 3)")
    return split.chunk_gaps(d)


def fragments(spark, sf_dir) -> DataFrame:
    """All documents as fragments of 700 bytes."""
    f = fx.document_files(spark, sf_dir).select("path", F.col("text").cast("binary").alias("bytes"))
    n = F.length("bytes")
    plan = f.select("path", n.alias("n"), F.posexplode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(700))).alias("frag_no", "offset"))
    plan = plan.select("path", F.lit(1).alias("chunk_index"), "frag_no", F.col("offset").cast("bigint").alias("offset"), F.least(F.lit(700), F.col("n") - F.col("offset")).cast("bigint").alias("length"))
    return content.fragments(f, plan)


@query(f"WITH {fx.SQL} SELECT path, hash, CAST(strlen(text) AS BIGINT) AS size FROM f")
def fragment_reassembly(spark, sf_dir):
    whole = content.reassembled(fragments(spark, sf_dir))
    return whole.select("path", F.md5("bytes").alias("hash"), "size")


@query(f"WITH {fx.SQL} SELECT path, CASE WHEN mtime_sec % 50 = 3 THEN 'length' ELSE 'hash' END AS problem FROM f WHERE (mtime_sec % 50 = 3 AND strlen(text) > 700) OR mtime_sec % 50 = 4")
def fragment_check(spark, sf_dir):
    files = fx.document_files(spark, sf_dir)
    k = F.col("mtime_sec") % 50
    manifest = files.select("path", F.octet_length("text").cast("bigint").alias("size"), F.when(k == 4, "0").otherwise(F.col("hash")).alias("hash"))
    lost = files.where(k == 3).select("path", F.lit(1).alias("frag_no"))
    return content.broken(fragments(spark, sf_dir).join(lost, ["path", "frag_no"], "left_anti"), manifest)


# Rounds


#: Folding all days equals the last event of each path, less those that removed it.
@query("""
WITH e AS (SELECT 'u' || user_id || '/' || event_type AS path, ts, event_id, CAST(ts AS DATE) AS day FROM events),
l AS (SELECT path, day, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS ts FROM e GROUP BY path, day),
x AS (SELECT path, min(day) AS first FROM l GROUP BY path),
g AS (SELECT path, max(day) AS reset FROM l JOIN x USING (path) WHERE id % 7 = 0 OR day = first GROUP BY path),
r AS (SELECT l.path, l.day, l.id, l.ts FROM l JOIN g ON g.path = l.path AND l.day >= g.reset),
s AS (SELECT l.path, l.id % 7 = 0 AS gone FROM l JOIN g ON g.path = l.path AND g.reset = l.day)
SELECT r.path, CAST(arg_max(id, day) AS BIGINT) AS size, CAST(floor(epoch(arg_max(ts, day))) AS BIGINT) AS mtime_sec FROM r JOIN s ON s.path = r.path AND NOT s.gone GROUP BY r.path
""")
def iterative_sync(spark, sf_dir):
    from ..schema import SNAPSHOT

    empty = spark.createDataFrame([], SNAPSHOT)
    return sync.fold(empty, fx.event_batches(spark, sf_dir)).select("path", "size", "mtime_sec")
