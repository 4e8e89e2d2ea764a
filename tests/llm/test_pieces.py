import random

import numpy as np
import pytest
import sentencepiece

from canopy.llm import pieces

DATA = "/root/testdata/sf0.001"
TEXTS = ["", " ", "a", "  a  b\n c▁d　é\U0001d518\x00x", "a▁b", "퟿", "<s>", "</s> <unk>", "<0x41>", "\t\n\r\n", "ﬁ ①", "a ", "\x01 a\x01b", " " * 70 + "x", "\n\n  \n a",
         "ab" * 300, "thequickbrownfoxjumpsoverthelazydog" * 20, "   " * 41, "你好世界" * 30, "the\nthe the\n the", "x" * 64, "x" * 65, "a" * 1000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def ids(enc, texts):
    flat, n = enc.encode(texts)
    out, at = [], 0
    for k in n:
        out.append(flat[at : at + k].tolist())
        at += k
    return out


def test_encoder_equals_library(library):
    enc = pieces.Encoder(pieces.Model())
    assert ids(enc, TEXTS) == [library.encode(t) for t in TEXTS]
    rng = random.Random(5)
    alphabet = ["th", "e", "in", "er", " ", "  ", "\n", "▁", "é", "S", "!!", "ü", "q", "z", "\U0001f600", "1", "|", "\t"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    assert ids(enc, made) == [library.encode(t) for t in made]
    assert [enc.decode(i) for i in ids(enc, made)] == [library.decode(i) for i in ids(enc, made)]


def test_forgetting_does_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    enc = pieces.Encoder(pieces.Model())
    for t in TEXTS:
        assert ids(enc, [t, "again the same"]) == [library.encode(t), library.encode("again the same")]


def test_query_on_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = pieces.query(spark, DATA).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode(t) for i, t in docs.items()}
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)


def test_nulls_and_columns(spark, library):
    df = spark.createDataFrame([(1, None, 5, "x"), (1, "", 5, "y"), (None, "two  words", None, None)], "doc_id long, text string, ids int, other string")
    got = pieces.decode(pieces.encode(df), text_col="again").collect()
    assert [(r.doc_id, r.text, r.ids, r.decoded, r.again, r.other) for r in got] == [(1, None, [], None, "", "x"), (1, "", [], "", "", "y"), (None, "two  words", library.encode("two  words"), "two  words", "two  words", None)]
    assert pieces.encode(df.limit(0)).collect() == []


def test_order_of_rows_compares_ties_only():
    rng = np.random.default_rng(6)
    for n, top in ((0, 3), (1, 3), (500, 3), (500, 2**60)):
        words = [rng.integers(0, top, n).astype(np.uint64) for _ in range(3)]
        for some in (words, words[:1]):
            order = pieces.order_of(some)
            assert sorted(order.tolist()) == list(range(n))
            rows = list(zip(*(w[order].tolist() for w in some)))
            assert rows == sorted(rows)


def test_pieces_are_searched_in_order(library):
    m = pieces.Model()
    assert m.texts == sorted(m.texts)
    assert [library.id_to_piece(int(i)) for i in m.ids] == m.texts
