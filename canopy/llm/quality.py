"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text are computed with numpy over the bytes of a batch: character classes,
word lengths, repetition of words, lines and sentence ends. Trees are grown on binned statistics of
a bounded sample of labelled documents, then flattened into arrays of features, thresholds and
children, through which all rows of a batch descend together.

Cases: a null text is an empty text, which is scored like any other; labels without a text or a
quality are not learned from, a document with several labels takes the lowest; without labels
all scores are 0.5; repeated rows score alike; an empty table gives an empty result; a very long
text is measured whole, in one step of its own; labels, lang, source and doc_id are no inputs of a
score; extra columns are kept by score() unless they take the
result's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: At most this many labelled documents are learned from: those whose hashed id is smallest.
SAMPLE = 20_000
CUT = 0.3
#: Bytes of text whose statistics are computed at once (a single text may be longer).
STEP = 256 << 10

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".?", "bang": b"!",
           "comma": b",;:", "bar": b"|", "symbol": b"#*$%&<>", "tag": b"{}[]()=/\\_~^+@", "quote": b"'\"`-", "high": bytes(range(0xC0, 0x100)), "tail": bytes(range(0x80, 0xC0))}
TABLE = np.zeros((256, len(CLASSES)))
for _i, _b in enumerate(CLASSES.values()):
    TABLE[list(_b), _i] = 1
NAMES = [*CLASSES][:-1] + ["length", "words", "word_length", "long_words", "short_words", "repeats", "distinct", "commonest", "caps_words", "stop_words", "mark_words", "line_words", "pair_repeats"]
_RNG = np.random.default_rng(20240229)
LETTER, PLACE = _RNG.integers(1, 2**63, 256, np.uint64) | np.uint64(1), _RNG.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
GAP = np.zeros(256, bool)
GAP[list(b" \t\n\r\x0b\x0c")] = True
KIND = np.zeros(256, np.uint8)  # 1 upper, 2 stop, 3 mark
KIND[list(CLASSES["upper"])] = 1
KIND[list(b".?")] = 2
KIND[list(b"!|#*$%&<>")] = 3


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text data[offsets[i]:offsets[i + 1]] (UTF-8)."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = data[lo:hi], offsets - lo
    hist = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:])]) if n else np.zeros((0, 256))
    counts = hist @ TABLE
    chars = counts.sum(1) - counts[:, -1] + (hist.sum(1) - counts.sum(1))
    size = np.maximum(chars, 1)
    k = len(CLASSES) - 1
    out[:, :k] = counts[:, :-1] / size[:, None]
    out[:, k] = np.log1p(chars)
    if not len(data):
        return out
    gap = GAP[data]
    first = ~gap
    first[1:] &= gap[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    first[bounds] = ~gap[bounds]  # a text's first byte begins a word, whatever the one before says
    begin = np.flatnonzero(first)
    if not len(begin):
        return out
    last = ~gap
    last[:-1] &= gap[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = ~gap[ends]
    end = np.flatnonzero(last) + 1
    size_b = end - begin
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data)))) if begin[0] == 0 else np.concatenate([np.zeros(begin[0], np.int64), np.arange(begin[0], len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))])
    value = LETTER[data] * PLACE[place & 63]
    value[gap] = 0
    word = np.add.reduceat(value, begin)
    word ^= word >> np.uint64(29)
    owner = np.searchsorted(offsets, begin, "right") - 1
    words = np.bincount(owner, minlength=n)
    per = np.maximum(words, 1)
    total = lambda x: np.bincount(owner, x, n)
    lengths = np.add.reduceat((~gap & ((data < 0x80) | (data >= 0xC0))).astype(np.int64), begin)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    key = (owner.astype(np.uint64) << np.uint64(44)) | (word >> np.uint64(20))
    key.sort()
    new = np.concatenate([[True], key[1:] != key[:-1]])
    run = np.diff(np.append(np.flatnonzero(new), len(key)))
    run_owner = (key[new] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, run_owner, run)
    pair = (word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])[owner[1:] == owner[:-1]]
    pair_owner = owner[:-1][owner[1:] == owner[:-1]]
    pair = (pair_owner.astype(np.uint64) << np.uint64(44)) | (pair >> np.uint64(20))
    pair.sort()
    pair_new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool)
    pairs = np.bincount((pair >> np.uint64(44)).astype(np.int64), minlength=n)
    pairs_new = np.bincount((pair[pair_new] >> np.uint64(44)).astype(np.int64), minlength=n)
    final = KIND[data[end - 1]]
    caps = (KIND[data[begin]] == 1) & (KIND[data[np.minimum(begin + 1, end - 1)]] == 1) & (size_b > 1)
    columns = (np.log1p(words), total(lengths) / per, total(lengths > 14) / per, total(lengths < 3) / per, total(same) / per, np.bincount(run_owner, minlength=n) / per, top / per,
               total(caps) / per, total(final == 2) / per, total(final == 3) / per, words / (counts[:, 4] + 1), (pairs - pairs_new) / np.maximum(pairs, 1))
    out[:, k + 1 :] = np.stack(columns, 1)
    return out


def batch_statistics(texts: pa.Array) -> np.ndarray:
    texts = pa.array(texts.cast(pa.large_string()).fill_null(""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    out = [np.zeros((0, len(NAMES)))]
    begin = 0
    while begin < len(texts):  # whole texts, as temporary arrays take some 50 bytes for each of their bytes
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + STEP, "right")) - 1)
        end = min(end, len(texts))
        out.append(statistics(data, offsets[begin : end + 1].copy()))
        begin = end
    return np.concatenate(out)


class Forest:
    """Trees as arrays: node i asks feature[i] <= threshold[i], then goes to left[i] or left[i] + 1; a leaf goes to itself."""

    def __init__(self, base: float, feature, threshold, left, value, roots, depth: int):
        self.base, self.feature, self.threshold, self.left, self.value, self.roots, self.depth = base, feature, threshold, left, value, roots, depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[rows, self.feature[at]] > self.threshold[at]
            at = self.left[at] + go
        return self.base + self.value[at].sum(1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [1 / (1 + np.exp(-self.raw(x[i : i + 1000]))) for i in range(0, len(x), 1000)]
        return np.concatenate(parts) if parts else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Forest:
    """Gradient boosting of the logistic loss on binned features."""
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "value": []}

    def node(value=0.0):
        i = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("value", value)):
            nodes[k].append(v)
        return i

    roots = []
    mean = float(y.mean()) if len(y) else 0.5
    base = 0.0 if not len(y) else float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    if len(y) and 0 < mean < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        flat = binned + np.arange(x.shape[1]) * bins
        score = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            roots.append(node())
            level = [(roots[-1], np.arange(len(y)))]
            for d in range(depth + 1):
                nxt = []
                for i, rows in level:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    best = (1e-6, 0, 0)
                    if d < depth and len(rows) >= 2 * least:
                        at = flat[rows].ravel()
                        shape = (x.shape[1], bins)
                        gs = np.bincount(at, np.repeat(grad[rows], x.shape[1]), x.shape[1] * bins).reshape(shape).cumsum(1)
                        hs = np.bincount(at, np.repeat(hess[rows], x.shape[1]), x.shape[1] * bins).reshape(shape).cumsum(1)
                        ns = np.bincount(at, minlength=x.shape[1] * bins).reshape(shape).cumsum(1)
                        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g * g / (h + ridge)
                        gain[(ns < least) | (len(rows) - ns < least)] = -1
                        k = int(gain.argmax())
                        best = max(best, (float(gain.flat[k]), *divmod(k, bins)))
                    if best[0] > 1e-6:
                        _, f, b = best
                        under = binned[rows, f] <= b
                        nodes["feature"][i], nodes["threshold"][i] = f, edges[f][b] if b < len(edges[f]) else np.inf
                        nodes["left"][i] = node()
                        nxt += [(nodes["left"][i], rows[under]), (node(), rows[~under])]
                    else:
                        nodes["value"][i] = -rate * g / (h + ridge)
                        score[rows] += nodes["value"][i]
                level = nxt
    return Forest(base, np.array(nodes["feature"], np.int64), np.array(nodes["threshold"]), np.array(nodes["left"], np.int64), np.array(nodes["value"]), np.array(roots, np.int64), depth)


def remainder(id_col: str, mod: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """A forest from labelled documents outside the held-out fifth."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").where(remainder("_id", 5) != 0)
    own = own.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t IS NOT NULL").join(F.broadcast(own), "_id").select("_id", "_y", "_t")

    def run(batches):
        for batch in common.slices(batches, 2):
            s = batch_statistics(batch.column(2))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), s.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["_id", "_y", "x"])

    got = common.in_arrow(rows, run, T.StructType([rows.schema["_id"], rows.schema["_y"], T.StructField("x", T.ArrayType(T.DoubleType()))])).toArrow()
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(NAMES)) if got.num_rows else np.zeros((0, len(NAMES)))
    y = (np.asarray(got["_y"]) > 0).astype(float)
    # Ids may come in any order; sums of floats shouldn't depend on it.
    order = np.lexsort([*x.T, y, np.asarray(got["_id"])])
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, text_col: str = "text", score_col: str = "score", drop_text: bool = False) -> DataFrame:
    """docs with the score of each text."""
    kept = [c for c in docs.columns if c != score_col and not (drop_text and c == text_col)]
    at, places = docs.columns.index(text_col), [docs.columns.index(c) for c in kept]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in common.slices(batches, at):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + [pa.array(forest.predict(batch_statistics(batch.column(at))))], schema.names)

    return common.in_arrow(docs, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(docs, common.table(spark, sf_dir, "labels"))
    out = score(docs, forest, drop_text=True)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
