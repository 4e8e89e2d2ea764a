"""SentencePiece encoding and decoding by suffix-array matching.

Texts of a batch are cut into units that no piece spans (at spaces and line breaks). Units not
seen before are concatenated and indexed by a suffix array, ordered as deep as the longest piece.
Every piece is binary-searched for its range of suffixes; each suffix in the range is an edge
(position, length, piece). Edges are sorted by position and relaxed. For a BPE model, relaxing
means: of the edges that join two neighbouring spans of a unit, take the best score, the leftmost
of equals, until no edge joins neighbours. That gives the ids of the library itself. (A shortest
path over scores, as for unigram models, would not: BPE scores are merge ranks.)

Cases: a null text has no ids and decodes to null; an empty text has none and decodes to ''; what
no piece covers becomes byte pieces; control pieces' strings in a text are ordinary text; a literal
U+2581 decodes to a space, as in the library; rows are independent, so ties, repeated rows and
empty tables need no care; other columns are kept by encode() unless their names are taken.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Spans of a unit up to which all units are relaxed side by side; longer ones use a heap.
WIDE = 64
#: Symbols in the units of each of a Python worker's two generations of memory, and symbols indexed
#: at once (a single unit may be longer).
REMEMBERED = 400_000
SYMBOLS = 100_000


class Model:
    """What encoding needs of a model file: pieces, scores, kinds."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        self.key = zlib.crc32(raw), len(raw)
        m = sentencepiece_model_pb2.ModelProto.FromString(raw)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or not m.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
        # By code points: pieces searched in this order are found side by side.
        normal = sorted(((i, p.piece, p.score) for i, p in enumerate(m.pieces) if p.type == 1), key=lambda x: x[1])
        if any(p.type in (4, 5) for p in m.pieces) or any(SPACE in p.lstrip(SPACE) for _, p, _ in normal):
            raise ValueError("user-defined pieces, or pieces over a space, are not supported")
        self.ids = np.array([i for i, _, _ in normal], np.int32)
        self.texts = [p for _, p, _ in normal]
        self.scores = np.array([s for _, _, s in normal])
        self.bytes = np.zeros(256, np.int32)
        self.decoded: list[bytes] = []
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
            self.decoded.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode())
        self.depth = max(map(len, self.texts))
        self.apart = not any("\n" in p for p in self.texts)


def keys_of(symbols: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of symbols as a few 64-bit words that sort alike, most significant first."""
    each = 64 // bits
    out = []
    for w in range(0, symbols.shape[1], each):
        word = np.zeros(len(symbols), np.uint64)
        for c in range(w, w + each):
            word <<= np.uint64(bits)
            if c < symbols.shape[1]:
                word |= symbols[:, c].astype(np.uint64)
        out.append(word)
    return out


def order_of(words: list[np.ndarray]) -> np.ndarray:
    """What sorts rows of words; only rows whose first words are equal are compared further."""
    order = np.argsort(words[0])
    if len(words) == 1 or len(order) < 2:
        return order
    first = words[0][order]
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    at = order[tied]  # sorted by groups of equal first words, so each group keeps its places
    order[tied] = at[np.lexsort([*(w[at] for w in words[:0:-1]), first[tied]])]
    return order


def as_bytes(words: list[np.ndarray]) -> np.ndarray:
    return np.stack(words, 1).astype(">u8").view(f"S{8 * len(words)}").ravel()


class Encoder:
    def __init__(self, model: Model):
        self.m = model
        self.known: dict[str, bytes] = {}
        self.held = 0  # symbols of `known`
        self.before: dict[str, bytes] = {}  # the last generation: units of use move on to `known`
        self.table = np.zeros((len(model.texts), model.depth), np.int64)
        for r, t in enumerate(model.texts):
            self.table[r, : len(t)] = [ord(c) for c in t]
        self.piece_lens = np.array([len(t) for t in model.texts], np.int64)
        self.alphabet, at = np.unique(self.table, return_inverse=True)  # 0, the end of a piece, comes first
        self.table = at.reshape(self.table.shape).astype(np.int32)
        self.cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if model.apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if self.m.apart and text[0] != " " and "  " not in text and SPACE not in text and "\x01" not in text:
            parts = (" " + text).replace("\n", "\x01\n\x01").replace(" ", "\x01" + SPACE).split("\x01")
            return [x for x in parts if x] if "\n" in text else parts[1:]
        return self.cut.findall((" " + text).replace(" ", SPACE))

    def edges(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """All occurrences, sorted by position: the row of the piece at [position, length], or -1.

        Suffixes are ordered by their first `depth` symbols; 0 separates units. What stands behind
        a separator may order suffixes, but no piece reaches over one."""
        depth = self.m.depth
        met = np.zeros(int(codes.max()) + 1, bool)
        met[codes] = True
        usable = self.alphabet[1:][self.alphabet[1:] < len(met)]
        usable = usable[met[usable]]
        bits = 8 if len(usable) < 254 else 16
        new = np.full(len(met), len(usable) + 1, np.int32)
        new[usable] = np.arange(1, len(usable) + 1)
        s = np.zeros(len(codes) + depth, np.int32)
        np.multiply(new[codes], inside, out=s[: len(codes)])
        suffixes = np.lib.stride_tricks.sliding_window_view(s, depth)[: len(codes)]
        words = keys_of(suffixes, bits)
        order = order_of(words)
        keys = as_bytes([w[order] for w in words])
        del words
        # Pieces whose letters all occur, in the same numbers.
        number = np.full(len(self.alphabet), -1, np.int32)
        number[0] = 0
        number[np.searchsorted(self.alphabet, usable)] = np.arange(1, len(usable) + 1)
        wanted = number[self.table]
        rows = np.flatnonzero((wanted >= 0).all(1))
        wanted = wanted[rows]
        low = as_bytes(keys_of(wanted, bits))
        high = as_bytes(keys_of(np.where(wanted > 0, wanted, 2**bits - 1), bits))
        lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
        count = hi - lo
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        out = np.full((len(codes), depth + 1), -1, np.int32)
        out[at, np.repeat(self.piece_lens[rows], count)] = np.repeat(rows, count)
        return out

    def learn(self, units: list[str]) -> None:
        """Ids of new units, relaxed over the edges of their suffix array."""
        lens = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("\x00".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum(lens + 1) - lens - 1
        inside = np.ones(len(codes), bool)
        inside[starts[1:] - 1] = False
        table = self.edges(codes, inside)
        depth = self.m.depth

        def edge(a, b):
            """The piece over [a, b), or -1."""
            n = b - a
            return np.where(n <= depth, table[a, np.minimum(n, depth)], -1)

        scores = self.m.scores
        begin = np.flatnonzero(inside)
        unit = np.repeat(np.arange(len(units)), lens)
        end = begin + 1
        wide = lens > WIDE
        done_b, done_e, done_u = [], [], []
        for u in np.flatnonzero(wide):
            b, e = self.relax_long(int(starts[u]), int(starts[u] + lens[u]), edge)
            done_b.append(b), done_e.append(e), done_u.append(np.full(len(b), u))
        on = ~wide[unit]
        begin, end, unit = begin[on], end[on], unit[on]
        joined = np.full(len(begin), -np.inf)  # score of joining a span with its right neighbour

        def rejoin(i, begin, end, unit):
            r = edge(begin[i], end[np.minimum(i + 1, len(end) - 1)])
            ok = (r >= 0) & (i + 1 < len(end))
            ok &= unit[np.minimum(i + 1, len(end) - 1)] == unit[i]
            return np.where(ok, scores[np.maximum(r, 0)], -np.inf)

        if len(begin):
            joined = rejoin(np.arange(len(begin)), begin, end, unit)
        while len(begin):
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.maximum.reduceat(joined, first)
            size = np.diff(np.concatenate([first, [len(unit)]]))
            live = best > -np.inf
            keep = np.repeat(~live, size)
            if keep.any():  # finished units leave
                done_b.append(begin[keep]), done_e.append(end[keep]), done_u.append(unit[keep])
                begin, end, unit, joined = begin[~keep], end[~keep], unit[~keep], joined[~keep]
                best, size = best[live], size[live]
                if not len(begin):
                    break
            hit = np.flatnonzero(joined == np.repeat(best, size))
            hit = hit[np.concatenate([[True], unit[hit[1:]] != unit[hit[:-1]]])]
            end[hit] = end[hit + 1]
            stay = np.ones(len(begin), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            begin, end, unit, joined = begin[stay], end[stay], unit[stay], joined[stay]
            at = place[hit]
            joined[at] = rejoin(at, begin, end, unit)
            left = at[at > 0] - 1
            joined[left] = rejoin(left, begin, end, unit)
        b, e, u = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_b, done_e, done_u))
        by = np.argsort(b, kind="stable")
        b, e, u = b[by], e[by], u[by]
        r = edge(b, e)
        ids = np.where(r >= 0, self.m.ids[np.maximum(r, 0)], -1).astype(np.int32)
        bounds = np.searchsorted(u, np.arange(len(units) + 1))
        bare = np.zeros(len(units), bool)
        bare[u[ids < 0]] = True
        raw, at = ids.tobytes(), (4 * bounds).tolist()
        self.known.update(zip(units, [raw[i:j] for i, j in zip(at, at[1:])]))
        for i in np.flatnonzero(bare):
            part = slice(bounds[i], bounds[i + 1])
            own = [[v] if v >= 0 else self.m.bytes[list(chr(codes[p]).encode("utf-8", "surrogatepass"))] for v, p in zip(ids[part], b[part])]
            self.known[units[i]] = np.concatenate(own).astype(np.int32).tobytes()

    def relax_long(self, a: int, z: int, edge) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long unit [a, z): a heap of the edges that join neighbours."""
        n = z - a
        end, nxt, prev, scores = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), self.m.scores
        end_of = dict(enumerate(end))
        pos = np.arange(a, z)
        table = {}
        for k in range(2, self.m.depth + 1):
            r = edge(pos, pos + k)
            for i in np.flatnonzero(r >= 0):
                if i + k <= n:
                    table[int(i), k] = float(scores[r[i]])
        heap = [(-v, i, i + 1, i + 2) for (i, k), v in table.items() if k == 2]
        heapq.heapify(heap)
        while heap:
            _, i, mid, e = heapq.heappop(heap)
            if end_of.get(i) != mid or end_of.get(mid) != e:
                continue
            del end_of[mid]
            end_of[i] = e
            nxt[i] = e
            if e < n:
                prev[e] = i
                if (v := table.get((i, end_of[e] - i))) is not None:
                    heapq.heappush(heap, (-v, i, e, end_of[e]))
            if (p := prev[i]) >= 0 and (v := table.get((p, e - p))) is not None:
                heapq.heappush(heap, (-v, p, i, e))
        b = np.array(sorted(end_of), np.int64)
        return b + a, np.array([end_of[int(i)] for i in b], np.int64) + a

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number for each text."""
        cut = [self.units(t) for t in texts]
        known = self.known
        if self.held > REMEMBERED:
            self.before, self.known, self.held = known, {}, 0
            known = self.known
        new = {u for units in cut for u in units if u not in known}
        if self.before:
            seen = new & self.before.keys()
            known.update((u, self.before[u]) for u in seen)
            new -= seen
            self.held += sum(map(len, seen))
        self.held += sum(map(len, new))
        some, room = [], SYMBOLS
        for u in new:
            some.append(u)
            room -= len(u) + 1
            if room <= 0:
                self.learn(some)
                some, room = [], SYMBOLS
        if some:
            self.learn(some)
        parts = [b"".join(map(known.__getitem__, units)) for units in cut]
        return np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64)

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.m.decoded.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


_ENCODERS: dict = {}


def encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast model; what it remembers serves later tasks too."""
    if shared.value.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.value.key] = Encoder(shared.value)
    return _ENCODERS[shared.value.key]


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = "decoded", drop: tuple = ()) -> DataFrame:
    """docs with `ids` and what they decode to, for whole texts; `drop`: columns left out."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model))
    taken = {ids_col, decoded_col, *drop}
    kept = [c for c in docs.columns if c not in taken]
    at = docs.columns.index(text_col)
    keep_at = [docs.columns.index(c) for c in kept]
    fields = [docs.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField(decoded_col, T.StringType())] * (decoded_col is not None)

    def run(batches):
        enc = encoder(shared)
        for some in common.slices(batches, at):
            texts = some.column(at).to_pylist()
            ids, n = enc.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(n)])
            columns = [some.column(i) for i in keep_at] + [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
            if decoded_col:
                columns.append(pa.array([None if t is None else enc.decode(ids[a:b].tolist()) for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return common.in_arrow(docs, run, T.StructType(fields))


def decode(docs: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of their ids; ids out of range fail, null ids decode to null."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model))

    @F.pandas_udf(T.StringType())
    def text(ids):
        enc = encoder(shared)
        return ids.map(lambda x: None if x is None else enc.decode(list(x)))

    return docs.withColumn(text_col, text(F.col(ids_col)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull()).alias("round_trip"))
