import pyarrow as pa
import sentencepiece

import corpus_pipeline
import test_lines
import test_minhash
import test_native
import test_quality
from canopy.llm import line_frequency, pieces, quality

DATA = "/root/testdata/sf0.001"


def brute(spark, data):
    """The ids and piece ids that should stay, stage by stage in plain Python."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    forest = quality.train(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    x = quality.batch_statistics(pa.array([r.text for r in docs.values()]))
    rows = [(i, r.source, r.text) for (i, r), s in zip(docs.items(), x) if test_quality.walk(forest, s) >= 0.3]
    rows = sorted((i, t) for i, t, _ in test_lines.brute(rows, line_frequency.RATIO, line_frequency.SURE))
    rows = [(i, t) for (i, t), (_, c) in zip(rows, test_minhash.brute(rows)) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaks = {k[0] for k in test_native.brute_hits(rows, items) if k[5]}
    rows = [(i, test_native.brute_cut(t, items)) for i, t in rows if i not in leaks]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    return {i: (t, library.encode(t)) for i, t in rows}


def test_run_equals_brute_force(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    want = brute(spark, DATA)
    assert {r.doc_id: (r.text, r.ids) for r in got} == want and len(got) == len(want)
    assert all(r.round_trip and r.n_chars == len(r.text) and r.n_pieces == len(r.ids) for r in got)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert n / 3 < len(got) < n


def test_stages_keep_columns_and_take_odd_rows(spark):
    text = "a fine text of some words, which is good enough to be kept. "
    rows = [(1, text * 3, "en", "s", 5, "x"), (1, text * 3, "en", "s", 5, "y"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (None, text, None, "s", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    for docs in (df, df.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, DATA)
            assert i == 4 or docs.columns == df.columns
            docs.collect()


def test_entry_registers_all():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)
