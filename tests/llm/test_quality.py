import zlib

import numpy as np
import pyarrow as pa

from canopy.llm import quality as Q

DATA = "/root/testdata/sf0.01"
TEXTS = ["", None, " ", "one", "ABC! def.\n\nabc  abc abc", "é È ü", "a b " * 3000, "x" * 70000, "\n", "Hello there.\nHello there.", " lead", "trail ", "end."]


def test_statistics_of_whole_texts():
    x = Q.batch_statistics(pa.array(TEXTS))
    assert x.shape == (len(TEXTS), len(Q.NAMES)) and np.isfinite(x).all()
    for i, t in enumerate(TEXTS):  # neighbours in a batch don't matter, nor how it is sliced
        assert np.allclose(Q.batch_statistics(pa.array([t], pa.string()))[0], x[i])
        assert np.allclose(Q.batch_statistics(pa.array(["zz zz", t, "YY!"]).slice(1, 1))[0], x[i])
        t = t or ""
        w = t.encode().split()
        at = lambda name: x[i][Q.NAMES.index(name)]  # noqa: E731, B023
        assert np.isclose(at("length"), np.log1p(len(t))) and np.isclose(at("words"), np.log1p(len(w)))
        if w:
            assert np.isclose(at("distinct"), len(set(w)) / len(w))
            assert np.isclose(at("commonest"), max(w.count(k) for k in set(w)) / len(w))
            assert np.isclose(at("repeats"), sum(a == b for a, b in zip(w, w[1:])) / len(w))
            assert np.isclose(at("word_length"), sum(len(k.decode()) for k in w) / len(w))
            assert np.isclose(at("stop_words"), sum(k[-1:] in b".?" for k in w) / len(w))
            assert np.isclose(at("upper"), sum("A" <= c <= "Z" for c in t) / len(t))


def walk(f, x):
    total = f.base
    for i in f.roots:
        while f.left[i] != i:
            i = f.left[i] + (x[f.feature[i]] > f.threshold[i])
        total += f.value[i]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    f = Q.fit(x, y)
    p = f.predict(x)
    assert np.allclose(p, [walk(f, r) for r in x])
    assert ((p > 0.5) == y).mean() > 0.95
    assert (Q.fit(np.zeros((0, 5)), np.zeros(0)).predict(x) == 0.5).all()
    assert (Q.fit(x, np.ones(800)).predict(x) > 0.9).all()


def test_query_held_out(spark):
    got = {r.doc_id: r for r in Q.query(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if got[r.doc_id].held_out}
    assert sum(got[i].predicted == q for i, q in y.items()) >= 0.97 * len(y)


def test_cases(spark):
    docs = spark.createDataFrame([(1, "fine text here.", "e"), (1, "fine text here.", "e"), (None, None, None), (2, "", "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = Q.score(docs, Q.train(docs, labels)).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "fine text here."), (1, "fine text here."), (None, None), (2, "")] and all(0 <= r.score <= 1 for r in got)
    none = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5} and Q.score(docs.limit(0), none).collect() == []
