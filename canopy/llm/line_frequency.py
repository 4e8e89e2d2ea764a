"""Line dedup by site-relative frequency.

Documents are grouped by host (their source). A host's pages are its distinct texts, so copies of
a page are one page. For each line the share of the host's pages that contain it is computed; a
line whose share exceeds `ratio` by more than `sure` standard errors is boilerplate of that host and
is dropped from all its documents. The error is that of a share of `ratio` among the host's pages:
on many pages the limit is the ratio itself, on few it is higher, in one formula for all sizes. Two
pages that share a line are enough; a page alone never is. A host can have no more boilerplate lines
than its mean number of lines a page divided by `ratio`, which bounds what a host's verdict holds.

Cases: lines are compared without white space at their ends; blank lines are never dropped; a null
text stays null; documents without a host are left alone; a document of boilerplate only becomes
empty; repeated rows are treated alike; a very long text is an array of its lines in one row; an
empty table gives an empty result; extra columns, whatever their names, are passed through by
clean() unless they take the name of a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATIO, SURE = 0.05, 4.5
TRIM = r"btrim({0}, ' \t\r\u000B\u000C')"


def boilerplate(docs: DataFrame, ratio: float = RATIO, sure: float = SURE, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """host, bad: hashes of the host's boilerplate lines; only hosts that have any."""
    d = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("t")).where("host IS NOT NULL AND t IS NOT NULL")
    d = d.selectExpr("host", "xxhash64(t) AS page", rf"array_distinct(transform(filter(split(t, '\n'), x -> {TRIM.format('x')} <> ''), x -> xxhash64({TRIM.format('x')}))) AS ls")
    totals = common.save(d.groupBy("host").agg(F.count_distinct("page").alias("total")), "host-pages")
    # A page counts once: the same line, page and host is one row. Copies are gone before the shuffle.
    seen = d.select("host", "page", F.explode("ls").alias("line")).distinct()
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    counts = common.save(counts, "line-pages")
    bad = counts.join(common.maybe_broadcast(totals, F.octet_length("host") + 24), "host").where(F.col("pages") > ratio * F.col("total") + sure * F.sqrt(ratio * (1 - ratio) * F.col("total")))
    return bad.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("bad"))


def clean(docs: DataFrame, ratio: float = RATIO, sure: float = SURE, text_col: str = "text", host_col: str = "source", dropped_col: str = "n_lines_dropped") -> DataFrame:
    """docs with boilerplate lines gone from the text, and how many were dropped."""
    host, lines, n = (common.free(docs, x) for x in ("_host", "_lines", "_n"))
    bad = common.save(boilerplate(docs, ratio, sure, text_col, host_col).withColumnsRenamed({"host": host, "bad": lines}), "boilerplate")
    side = common.maybe_broadcast(bad, F.octet_length(host) + 8 * F.size(lines) + 32)
    d = docs.join(side, F.col(host_col) == F.col(host), "left")
    t = f"`{text_col}`"
    # The expressions run only for documents of a host with boilerplate.
    left = rf"array_join(filter(split({t}, '\n'), x -> {TRIM.format('x')} = '' OR NOT array_contains({lines}, xxhash64({TRIM.format('x')}))), '\n')"
    hit = rf"size(filter(split({t}, '\n'), x -> {TRIM.format('x')} <> '' AND array_contains({lines}, xxhash64({TRIM.format('x')}))))"
    d = d.withColumn(n, F.expr(f"cast(CASE WHEN {lines} IS NULL OR {t} IS NULL THEN 0 ELSE {hit} END AS bigint)"))
    d = d.withColumn(text_col, F.expr(f"CASE WHEN {n} = 0 THEN {t} ELSE {left} END"))
    return d.withColumn(dropped_col, F.col(n)).drop(host, lines, n)


def query(spark, sf_dir: str) -> DataFrame:
    return clean(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_lines_dropped")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, host, text, i, ls[i] AS line, regexp_replace(ls[i], '^[ \t\r\x0B\x0C]+|[ \t\r\x0B\x0C]+$', '', 'g') AS k FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE text IS NOT NULL)),
p AS (SELECT host, count(DISTINCT text) AS total FROM d WHERE host IS NOT NULL GROUP BY host),
b AS (SELECT host, k FROM l JOIN p USING (host) WHERE k <> '' GROUP BY host, k, total HAVING count(DISTINCT text) > 1 AND count(DISTINCT text) > 0.05 * total + 4.5 * sqrt(0.05 * 0.95 * total)),
m AS (SELECT l.r, l.doc_id, l.i, l.line, b.k IS NOT NULL AS bad FROM l LEFT JOIN b ON l.host = b.host AND l.k = b.k)
SELECT d.doc_id, any_value(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.s, '') END) AS text, CAST(any_value(coalesce(t.n, 0)) AS BIGINT) AS n_lines_dropped
FROM d LEFT JOIN (SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS s, count(*) FILTER (bad) AS n FROM m GROUP BY r) t ON d.r = t.r GROUP BY d.r, d.doc_id
"""
