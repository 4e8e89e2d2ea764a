import zlib

import numpy as np

from canopy.llm import language as L

DATA = "/root/testdata/sf0.01"


def brute(text):
    """All n-grams of the padded words, in no order."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            w = f" {word} "
            out += [w[i : i + n] for n in L.SIZES for i in range(len(w) - n + 1)]
            word = ""
    return out


def test_grams():
    texts = ["", None, "a", "Ab, cd", "é1ü", "the the", "x\0y", "İi", "  "]
    h, own, count = L.grams(texts)
    names = {}
    for i, t in enumerate(texts):
        t = t.replace("\0", " ") if t else t
        want = brute(t)
        mine = h[own == i]
        assert len(mine) == len(want)
        for n in L.SIZES:
            g, _, _ = L.grams([f"{t}"])
        names |= dict.fromkeys(want)
        assert count[i] == sum(c.isalpha() for c in (t or "").lower())
        assert sorted(mine) == sorted(L.grams([t])[0])
    assert len(set(h.tolist())) == len(names)


def test_filters_hold_all_they_were_given():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, 20000).astype(np.uint64) for _ in range(10)]
    f = L.Filters([f"l{i}" for i in range(10)], sets)
    for i, s in enumerate(sets):
        assert (f.languages(s)[:, i // 8] >> (i % 8) & 1).all()
    other = rng.integers(0, 2**63, 50000).astype(np.uint64)
    for i in range(10):
        assert abs((f.languages(other)[:, i // 8] >> (i % 8) & 1).mean() - f.false[i]) < 2e-3
    assert L.Filters([], []).predict(["abc"])[0] == ["und"]


def test_query_held_out(spark):
    got = {r.doc_id: r for r in L.query(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    out = [r for r in docs if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) >= 0.97 * len(out)


def test_cases(spark):
    rows = [(i, ("the cat and the dog", "der hund und die katze")[i % 2], ("en", "de")[i % 2]) for i in range(40)] + [(50, None, "en"), (51, "", None), (52, "12 !?", "xx"), (None, "the dog", None), (53, "Katze und", None), (53, "Katze und", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    f = L.train(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.predict(df, f).collect()]
    assert [(i, p) for i, p, _ in got[:40]] == [(i, ("en", "de")[i % 2]) for i in range(40)]
    assert got[40:43] == [(50, "und", 0.0), (51, "und", 0.0), (52, "und", 0.0)] and [g[1] for g in got[43:]] == ["en", "de", "de"]
    assert L.predict(df.limit(0), f).collect() == []
    assert {r.lang_pred for r in L.predict(df, L.train(df.limit(0))).collect()} == {"und"}
