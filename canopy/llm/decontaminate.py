"""Benchmark decontamination with a positional inverted index.

The index holds the postings (term, document, position) of the benchmark's terms over the whole
corpus; it is written once and the terms' corpus frequencies are read off it. The two rarest places
of each 13-word window of a test item are its anchors: (term, offset) pairs. A posting of an anchor's
term is moved back by the offset; where both anchors of some window meet at one document and place,
the window is compared word by word with the text: an exact phrase. Where the two come within `slop`
words of meeting, the item is a proximity match.

Lists are joined by anchor, not by item or window: at one place of a document there is one word at
each of a window's 13 offsets, so however common the terms and however many items share them, a
place has at most 13 adjusted postings of either anchor.

Cases: null texts have no words; an item of fewer words than a window is one window; items without
words are never found; a window with a term that the corpus lacks can't occur; repeated rows of
documents are judged each by its own text, but proximity by doc_id; repeated item_ids count once in
n_items; a very long text is one row of words, and its postings are rows; empty tables give no hits
or no rows; extra columns are ignored, or kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: How far two anchors may be from meeting to be called close, in words.
SLOP = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text as they stand there. Only the first and the last part can be empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase (words with a space between), l (their number) and the items that have this window."""
    d = items.select("item", F.transform(words(F.col("text")), lowered).alias("iw")).where(F.size("iw") > 0)
    d = d.withColumn("l", F.least(F.size("iw"), F.lit(window)))
    d = d.select("item", "l", F.explode(F.expr("transform(sequence(0, size(iw) - l), b -> array_join(slice(iw, b + 1, l), ' '))")).alias("phrase"))
    return d.groupBy("phrase", "l").agg(F.sort_array(F.collect_set("item")).alias("items"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The inverted index of the given terms (term, id): doc_id, pos, id."""
    seen = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word")).select("doc_id", "pos", lowered(F.col("word")).alias("term"))
    return seen.join(common.maybe_broadcast(terms, F.octet_length("term") + 24), "term").select("doc_id", "pos", "id")


def anchors(wins: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """phrase, l, and the two rarest places of each window that can occur: ids t1, t2 at offsets o1, o2
    (equal if the window is one word)."""
    freq = common.save(terms.join(common.maybe_broadcast(index.groupBy("id").agg(F.count(F.lit(1)).alias("n")), 16), "id"), "frequency")
    at = wins.select("phrase", "l", F.posexplode(F.split("phrase", " ")).alias("o", "term"))
    at = at.join(common.maybe_broadcast(freq, F.octet_length("term") + 32), "term")
    # A term that the corpus lacks is not among them, so its windows have too few places.
    rank = at.groupBy("phrase", "l").agg(F.sort_array(F.collect_list(F.struct("n", "o", "id"))).alias("ts")).where(F.size("ts") == F.col("l"))
    first, second = F.col("ts")[0], F.coalesce(F.get("ts", F.lit(1)), F.col("ts")[0])
    return rank.select("phrase", "l", first["id"].alias("t1"), first["o"].alias("o1"), second["id"].alias("t2"), second["o"].alias("o2"))


def aligned(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """doc_id, start, t, o: a posting of an anchor's term, moved back to where its windows would begin."""
    places = anchored.select(F.col("t1").alias("t"), F.col("o1").alias("o")).union(anchored.select("t2", "o2")).distinct()
    return index.join(common.maybe_broadcast(places, 16), F.col("id") == F.col("t")).select("doc_id", (F.col("pos") - F.col("o")).alias("start"), "t", "o")


def meetings(moved: DataFrame, anchored: DataFrame) -> DataFrame:
    """doc_id, start, l: where both anchors of some window stand."""
    pairs = anchored.select("t1", "o1", "t2", "o2", "l").distinct()
    at = moved.groupBy("doc_id", "start").agg(F.collect_set(F.struct("t", "o")).alias("as"))  # at most one for each offset
    one = at.select("doc_id", "start", "as", F.explode("as").alias("a")).select("doc_id", "start", "as", F.col("a.t").alias("t1"), F.col("a.o").alias("o1"))
    both = one.join(common.maybe_broadcast(pairs, 24), ["t1", "o1"]).where(F.exists("as", lambda x: (x["t"] == F.col("t2")) & (x["o"] == F.col("o2"))))
    return both.select("doc_id", "start", "l").distinct()


def proximate(moved: DataFrame, anchored: DataFrame, slop: int) -> DataFrame:
    """doc_id, t1, o1, t2, o2: the anchors of a window of two words or more that are at most `slop`
    words from meeting.

    Places at most slop apart share one of two overlapping ranges of slop + 1."""
    pairs = anchored.where("l > 1").select("t1", "o1", "t2", "o2").distinct()
    k = F.floor(F.col("start") / (slop + 1))
    near = moved.select("doc_id", "start", "t", "o", F.explode(F.array(k, k - 1)).alias("k"))
    near = near.groupBy("doc_id", "k").agg(F.collect_set(F.struct("t", "o", "start")).alias("as"))
    one = near.select("doc_id", "as", F.explode("as").alias("a")).select("doc_id", "as", F.col("a.start").alias("s"), F.col("a.t").alias("t1"), F.col("a.o").alias("o1"))
    both = one.join(common.maybe_broadcast(pairs, 24), ["t1", "o1"])
    met = F.exists("as", lambda x: (x["t"] == F.col("t2")) & (x["o"] == F.col("o2")) & (F.abs(x["start"] - F.col("s")) <= slop))
    return both.where(met).select("doc_id", "t1", "o1", "t2", "o2").distinct()


#: Intervals (b, e), sorted: how many places their union covers.
COVERED = "aggregate({0}, named_struct('n', 0, 'e', 0), (a, x) -> named_struct('n', a.n + greatest(x.e - greatest(x.b, a.e), 0), 'e', greatest(a.e, x.e)), a -> a.n)"


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. Exact phrases: doc_id, text_hash, hits (places b to e in the document, sorted) and
    items; only of documents that have any. Proximity: doc_id, near (items, sorted)."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wins = common.save(windows_of(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL"), window), "windows")
    terms = common.save(wins.select(F.explode(F.split("phrase", " ")).alias("term")).distinct().withColumn("id", F.monotonically_increasing_id()), "terms")
    index = common.save(postings(docs, terms), "index")
    anchored = common.save(anchors(wins, terms, index), "anchors")
    moved = common.save(aligned(index, anchored), "aligned")
    met = common.save(meetings(moved, anchored).groupBy(F.col("doc_id").alias("met_id")).agg(F.sort_array(F.collect_list(F.struct("start", "l"))).alias("met")), "met")
    by = common.maybe_broadcast(met, F.lit(24) + 8 * F.size("met"))
    own = docs.join(by, F.col("doc_id").eqNullSafe(F.col("met_id"))).select("doc_id", F.xxhash64("text").alias("text_hash"), "met", words(F.col("text")).alias("dw"))
    # The fence keeps the words from being split anew for each place.
    own = own.withColumn("fence", F.monotonically_increasing_id()).where("fence >= 0").select("doc_id", "text_hash", "dw", F.explode("met").alias("m"))
    said = F.transform(F.slice("dw", F.col("m.start") + 1, F.col("m.l")), lowered)
    own = own.where("m.start >= 0").select("doc_id", "text_hash", F.col("m.start").alias("b"), (F.col("m.start") + F.col("m.l")).alias("e"), F.array_join(said, " ").alias("phrase"))
    whole = wins.select("phrase", F.monotonically_increasing_id().alias("win"), "items")
    whole = common.save(whole, "phrases")
    hits = common.save(own.join(common.maybe_broadcast(whole.select("phrase", "win"), F.octet_length("phrase") + 24), "phrase").select("doc_id", "text_hash", "b", "e", "win"), "hits")
    spans = hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("hits"))
    size = F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    items = hits.select("doc_id", "text_hash", "win").distinct().join(common.maybe_broadcast(whole.select("win", "items"), size + 16), "win")
    items = items.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    same = lambda a, b, *c: F.expr(" AND ".join(f"{a}.{x} <=> {b}.{x}" for x in c))
    exact = spans.alias("s").join(items.alias("i"), same("s", "i", "doc_id", "text_hash")).select("s.doc_id", "s.text_hash", "hits", "items")
    close = proximate(moved, anchored, slop)
    named = anchored.join(common.maybe_broadcast(whole.select("phrase", "items"), F.octet_length("phrase") + size + 32), "phrase").select("t1", "o1", "t2", "o2", F.explode("items").alias("item")).distinct()
    named = common.save(named, "named")
    near = close.join(common.maybe_broadcast(named, F.octet_length("item") + 40), ["t1", "o1", "t2", "o2"]).groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("near"))
    exact, near = common.save(exact, "exact"), common.save(near, "near")
    for old in (terms, index, moved, met, hits, named, anchored, wins, whole):
        common.forget(old)
    return exact, near


def judge(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, **names) -> DataFrame:
    """doc_id, n_words, n_hit, items (with occurring windows), near (others that come close),
    contaminated and hits; with `carry` the whole row of documents as `row`."""
    exact, near = find(documents, benchmark, id_col=id_col, text_col=text_col, **names)
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if carry else []
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), GAP)
    d = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), parts.alias("parts"), *row)
    d = d.withColumn("n_words", (F.size("parts") - (F.col("parts")[0] == "").cast("int") - ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")).cast("long")).drop("parts")
    strings = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    exact = exact.withColumnsRenamed({"doc_id": "exact_id", "text_hash": "exact_hash"})
    near = near.withColumnRenamed("doc_id", "near_id")
    d = d.join(common.maybe_broadcast(exact, 48 + 8 * F.size("hits") + strings("items")), F.col("doc_id").eqNullSafe(F.col("exact_id")) & (F.col("text_hash") == F.col("exact_hash")), "left")
    d = d.join(common.maybe_broadcast(near, 24 + strings("near")), F.col("doc_id").eqNullSafe(F.col("near_id")), "left")
    none = F.array().cast("array<string>")
    d = d.withColumn("items", F.coalesce("items", none)).withColumn("n_hit", F.when(F.col("hits").isNull(), 0).otherwise(F.expr(COVERED.format("hits"))).cast("long"))
    bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return d.select("doc_id", "n_words", "n_hit", "items", F.array_except(F.coalesce("near", none), "items").alias("near"), bad.alias("contaminated"), F.coalesce("hits", F.array().cast("array<struct<b: int, e: int>>")).alias("hits"), *["row"] * carry)


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """documents without the contaminated ones; from others with hits, the words hit and the gap
    behind each of them are cut out."""
    d = judge(documents, benchmark, text_col=text_col, carry=True, **names)
    own, hit = F.col("row").getField(text_col), F.col("n_hit") > 0
    gap = GAP[1:-2]
    # Words and gaps take turns, so word i is part 2i, or 2i + 1 behind a leading gap.
    lead = F.when(F.regexp_like(F.substring(own, 1, 1), F.lit(f"[{gap}]")), 1).otherwise(0)
    d = d.withColumn("parts", F.when(hit, F.regexp_extract_all(own, F.lit(f"([^{gap}]+|[{gap}]+)"), F.lit(1))))
    d = d.withColumn("cuts", F.when(hit, F.transform("hits", lambda h: F.struct((2 * h["b"] + lead).alias("b"), (2 * h["e"] + lead).alias("e")))))
    # Pushed below these arrays, or merged with what is above, their expressions would be evaluated
    # anew for each element of another. A filter isn't moved past an expression of no fixed value.
    d = d.withColumn("fence", F.monotonically_increasing_id()).where(~F.col("contaminated") & (F.col("fence") >= 0))
    kept = F.filter("parts", lambda p, j: ~F.exists("cuts", lambda c: (j >= c["b"]) & (j < c["e"])))
    text = F.when(hit, F.array_join(kept, "")).otherwise(own)
    return d.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in documents.columns])


def query(spark, sf_dir: str) -> DataFrame:
    d = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated", F.size("near").cast("long").alias("n_near"),
    )


#: Ids sort as strings by code point in both engines.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
j AS (SELECT item, w, least(len(w), 13) AS l FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT item, l, array_to_string(w[b:b + l - 1], ' ') AS g FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS b FROM j)),
l AS (SELECT DISTINCT l FROM k),
g AS (SELECT r, l, b, array_to_string(w[b:b + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS b FROM d, l WHERE len(w) >= l)),
h AS (SELECT r, b, g.l AS l, item FROM g JOIN k ON g.l = k.l AND g.g = k.g),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(b, b + l)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY r),
v AS (SELECT g, l, unnest(string_split(g, ' ')) AS term, unnest(range(0, l)) AS o FROM (SELECT DISTINCT g, l FROM k)),
p AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d) WHERE term IN (SELECT term FROM v)),
f AS (SELECT term, count(*) AS n FROM p GROUP BY term),
a AS (SELECT g, term, o, row_number() OVER (PARTITION BY g ORDER BY n, o) AS rank FROM v JOIN f USING (term) QUALIFY count(*) OVER (PARTITION BY g) = l AND l > 1),
c AS (SELECT DISTINCT item, x.term AS t1, x.o AS o1, y.term AS t2, y.o AS o2 FROM a x JOIN a y ON x.g = y.g AND x.rank = 1 AND y.rank = 2 JOIN k ON k.g = x.g),
q AS (SELECT DISTINCT x.doc_id, c.item FROM c JOIN p x ON x.term = t1 JOIN p y ON y.term = t2 AND x.doc_id = y.doc_id AND abs((x.pos - o1) - (y.pos - o2)) <= 3),
e AS (SELECT d.r, count(*) AS n_near FROM d JOIN q USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.r = d.r AND h.item = q.item) GROUP BY d.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r) LEFT JOIN e USING (r)
"""
