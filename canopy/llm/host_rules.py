"""Quality rules with a verdict per host.

Each text is measured by row-local expressions; failures are summed by host (the source of a
document), the hosts' failure rates are shrunk towards a beta prior fitted to all hosts by
moments, and a host whose shrunk rate is three times the hosts' mean rate (but 0.2 to 0.5) takes its
documents along. Where hosts fail alike, none is bad.

Cases: a null or empty text has no words, so it fails; a null host is no host: its documents
are judged alone; repeated rows are separate rows; a very long text is measured whole, in arrays of
its words; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD_GAP = r"[\\x20\\x09-\\x0D]+"
WINDOW = 5
STIFF, LIFT, LIMITS = 1e-2, 3.0, (0.2, 0.5)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for each row.

    Windows are compared by a 64-bit hash. Arrays live in columns of their own: an expression
    inside a lambda would be evaluated anew for each element."""
    space = r"' \t\n\u000B\u000C\r'"
    d = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.selectExpr(
        "doc_id",
        "host",
        f"length(translate(t, {space}, '')) AS word_chars",
        "length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols",
        f"CASE WHEN btrim(t, {space}) = '' THEN cast(array() AS array<string>) ELSE split(btrim(t, {space}), '{WORD_GAP}') END AS w",
        f"filter(split(t, '\\n'), x -> btrim(x, {space}) <> '') AS ls",
    )
    hashed = ", ".join(f"get(w, i + {k})" for k in range(WINDOW))
    d = d.selectExpr(
        "doc_id",
        "host",
        "word_chars",
        "n_symbols",
        "size(w) AS n_words",
        "size(ls) - size(array_distinct(ls)) AS n_dup_lines",
        f"CASE WHEN size(w) >= {WINDOW} THEN transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({hashed})) END AS h",
    )
    d = d.withColumn("p", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) END"))
    d = d.withColumn("q", F.expr("array_sort(transform(filter(p, (x, i) -> coalesce(get(p, i - 1).h = x.h, false) OR coalesce(get(p, i + 1).h = x.h, false)), x -> x.i))"))
    repeat = f"coalesce(aggregate(transform(q, (x, i) -> least({WINDOW}, coalesce(get(q, i + 1) - x, {WINDOW}))), 0, (a, x) -> a + x), 0)"
    return d.selectExpr(
        "doc_id", "host", "cast(n_words AS bigint) AS n_words", "cast(word_chars AS bigint) AS word_chars", "cast(n_symbols AS bigint) AS n_symbols",
        "cast(n_dup_lines AS bigint) AS n_dup_lines", f"cast({repeat} AS bigint) AS n_repeat_words",
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk by the beta prior that fits the hosts' raw rates) and limit."""
    hosts = measured.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = common.save(hosts, "hosts")
    raw = F.col("failed") / F.col("n")
    m, v, k = hosts.agg(F.avg(raw), F.var_samp(raw), F.avg(1 / F.col("n"))).first()
    a, b = beta_prior(m, v, k)
    return hosts.withColumn("rate", (F.col("failed") + a) / (F.col("n") + a + b)).withColumn("limit", F.lit(limit_of(m)))


def beta_prior(mean: float | None, var: float | None, noise: float | None) -> tuple[float, float]:
    """By moments: the variance between hosts is the raw one less what sampling adds. The prior weighs
    as much as 1 / STIFF documents at most, so that a host's own record counts even where hosts are alike."""
    if mean is None or not 0 < mean < 1:
        return (0.5, 0.5) if mean is None or mean == 0 else (1.0, 0.5)
    spread = mean * (1 - mean)
    between = max((var or 0.0) - spread * noise, spread * STIFF)
    strength = max(spread / between - 1, 1.0)
    return mean * strength, (1 - mean) * strength


def limit_of(mean: float | None) -> float:
    """A host is bad if it fails LIFT times as often as hosts do on average, within the bounds of LIMITS."""
    return min(max(LIFT * (mean or 0.0), LIMITS[0]), LIMITS[1])


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The measures of each row, base_failed, and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = common.save(measure(df, id_col, text_col, host_col).withColumn("base_failed", failed), "host-rules")
    bad = common.save(host_rates(rows).where("rate > limit").select("host", F.lit(True).alias("bad_host")), "bad-hosts")
    out = rows.join(common.maybe_broadcast(bad, F.octet_length("host") + 32), "host", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("bad_host"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    return apply(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The hosts' verdict as SQL follows the same moments.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
q AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS x FROM c WHERE c > 1),
n AS (SELECT r, sum(x) AS n_repeat_words FROM q GROUP BY r),
m AS (SELECT doc_id, host, len(w) AS n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT avg(f / n) AS m, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS k FROM h),
s AS (SELECT m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * k, m * (1 - m) * 1e-2) - 1, 1) AS s FROM p),
x AS (SELECT host FROM h, s WHERE (f + m * s) / (n + s) > least(greatest(3 * m, 0.2), 0.5))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM x)) AS kept FROM b
"""
