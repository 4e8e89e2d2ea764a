"""Language identification by language-bitmask n-gram filters.

The n-grams of each language go into a Bloom filter; the filters of all languages are sliced by
bit, so that a cell holds a mask of languages and the AND of an n-gram's cells is the mask of all
languages that contain it. A text is given to the language with most of its n-grams, after each
count is corrected for the false positives that the language's fill makes expected.

Cases: a null text, or one without a letter, is `und` with score 0; so is any text if nothing was
learned; a text that matches no language gets the commonest one with score 0; ties go to the
commoner language, then by name; null langs aren't learned from; repeated rows are judged alike; an
empty table gives an empty result; a very long text is read whole, in one step; lang, source and doc_id are no inputs of a prediction; extra
columns are kept by predict() unless they take a result's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: About this many documents a language are learned from (all of a language that has fewer).
SAMPLE = 3000
SIZES = (2, 3, 4)
#: An n-gram belongs to a language if it makes up this share of its n-grams, so a language has at
#: most 1 / SHARE of them.
SHARE = 1e-4
CELLS, PROBES = 1 << 20, 3
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
LETTERS = np.zeros(0x110000, bool)


def letters() -> np.ndarray:
    if not LETTERS[97]:
        LETTERS[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return LETTERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts' words, the text of each, and each text's letters.

    A word is a run of letters in lower case with a gap at either side; no n-gram spans a gap."""
    joined = "".join(f" {t or ''}\0" for t in texts).lower()
    if joined.count("\0") != len(texts):  # a text with NUL characters
        joined = "".join(f" {(t or '').replace(chr(0), ' ')}\0" for t in texts).lower()
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[raw]
    owner = np.cumsum(raw == 0)
    count = np.bincount(owner[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]
    keep[1:] |= is_letter[:-1]
    code, own, gap = np.where(is_letter, raw, 32)[keep].astype(U), owner[keep], ~is_letter[keep]
    own = np.where(raw[keep] == 0, own - 1, own)  # a text's end is a gap of its own
    out, who = [], []
    h = mix(code * GOLD)
    for n in range(2, max(SIZES) + 1):
        if len(code) < n:
            break
        h = mix(h[:-1] * GOLD + code[n - 1 :])
        ok = own[n - 1 :] == own[: len(h)]
        for i in range(1, n - 1):
            ok &= ~gap[i : i + len(h)]
        if n == 2:
            ok &= ~(gap[:-1] & gap[1:])
        if n in SIZES:
            out.append(h[ok] ^ U(n))
            who.append(own[: len(h)][ok])
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate(who) if who else np.zeros(0, np.int64), count


def chunks(texts: list, room: int = 300_000):
    """Slices of the list of about `room` characters, whole texts each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= room:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


class Filters:
    def __init__(self, names: list[str], sets: list[np.ndarray]):
        """names: languages, the commonest first."""
        self.names = names
        self.words = max(1, -(-len(names) // 8))
        self.cells = np.zeros((CELLS, self.words), np.uint8)
        for i, grams_ in enumerate(sets):
            for at in self.probes(grams_):
                self.cells[at, i // 8] |= np.uint8(1 << i % 8)
        fill = np.array([((self.cells[:, i // 8] >> np.uint8(i % 8)) & 1).mean() for i in range(len(names))])
        self.false = fill**PROBES

    @staticmethod
    def probes(h: np.ndarray):
        for p in range(PROBES):
            h = mix(h + GOLD)
            yield (h >> U(44)).astype(np.int64) & (CELLS - 1)

    def languages(self, h: np.ndarray) -> np.ndarray:
        """Masks of the languages that contain each n-gram."""
        mask = None
        for at in self.probes(h):
            mask = self.cells[at] if mask is None else mask & self.cells[at]
        return mask

    def predict(self, texts: list) -> tuple[list, np.ndarray]:
        found, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.names:
            return found, score
        for a, b in chunks(texts):
            h, own, count = grams(texts[a:b])
            mask = self.languages(h)
            total = np.bincount(own, minlength=b - a)
            hits = np.stack([np.bincount(own, (mask[:, i // 8] >> np.uint8(i % 8)) & 1, b - a) for i in range(len(self.names))], 1)
            true = np.maximum(0, (hits - self.false * total[:, None]) / (1 - self.false))
            best = true.argmax(1)
            two = -np.sort(-true, 1)[:, :2]
            margin = two[:, 0] / np.maximum(two.sum(1), 1e-9)
            for i in np.flatnonzero(count):
                found[a + i] = self.names[best[i]]
                score[a + i] = margin[i] if two[i, 0] > 0 else 0.0
        return found, np.clip(score, 0, 1)


def remainder(id_col: str, mod: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from documents with a language outside the held-out quarter."""
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l IS NOT NULL AND t IS NOT NULL").where(F.coalesce(remainder("i", 4) != 2, F.lit(True)))
    counts = {r["l"]: r["count"] for r in own.groupBy("l").count().collect()}
    if not counts:
        return Filters([], [])
    names = sorted(counts, key=lambda k: (-counts[k], k))
    chance = F.coalesce(*[F.when(F.col("l") == k, F.lit(min(1.0, sample / counts[k]))) for k in names])
    some = own.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < chance * 1_000_000).select("l", "t")

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs) if x == k]
                for a, b in chunks(mine):
                    g, n = np.unique(grams(mine[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["l", "g", "n"])

    seen = common.save(common.in_arrow(some, run, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")), "grams")
    totals = {r["l"]: r["n"] for r in seen.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    total = F.coalesce(*[F.when(F.col("l") == k, F.lit(float(v))) for k, v in totals.items()], F.lit(1.0))
    got = seen.withColumn("s", F.col("n") / total).where((F.col("s") >= SHARE) & (F.col("n") > 1)).select("l", "g").toArrow()
    common.forget(seen)
    lang, g = np.array(got["l"].to_pylist(), object), np.asarray(got["g"]).view(U)
    return Filters(names, [g[lang == k] for k in names])


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", drop_text: bool = False) -> DataFrame:
    kept = [c for c in docs.columns if c not in (pred_col, score_col) and not (drop_text and c == text_col)]
    at, places = docs.columns.index(text_col), [docs.columns.index(c) for c in kept]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for some in common.slices([batch], at):
                found, score = shared.value.predict(some.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(i) for i in places] + [pa.array(found, pa.string()), pa.array(score)], schema.names)

    return common.in_arrow(docs, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(docs), drop_text=True)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
