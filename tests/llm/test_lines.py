from collections import Counter, defaultdict

from canopy.llm import line_frequency as L

TRIM = " \t\r\x0b\x0c"


def brute(rows, ratio, sure):
    pages = defaultdict(set)
    for _, host, text in rows:
        if host is not None and text is not None:
            pages[host].add(text)
    bad = set()
    for host, texts in pages.items():
        n = Counter(k for t in texts for k in {x.strip(TRIM) for x in t.split("\n")} if k)
        bad |= {(host, k) for k, v in n.items() if v > 1 and v > ratio * len(texts) + sure * (ratio * (1 - ratio) * len(texts)) ** 0.5}
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        ls = text.split("\n")
        keep = [x for x in ls if (host, x.strip(TRIM)) not in bad]
        out.append((i, "\n".join(keep), len(ls) - len(keep)))
    return Counter(out)


def test_cases(spark):
    rows = [(i, "a", f"Menu \nstory {i}\n\n  Foot\t") for i in range(8)] + [(100 + i, "a", "copy\nof a page") for i in range(30)] + [(200 + i, "b", f"Menu\n{i}") for i in range(3)]
    rows += [(i, "c", f"x{i}\n\ny{i % 2}\n" * 3) for i in range(300, 340)] + [(1, None, "Menu\nFoot"), (2, "a", None), (3, "a", ""), (4, "a", "Menu"), (4, "a", "Menu"), (None, "a", "Menu\nfine"), (9, "", "Menu")]
    df = spark.createDataFrame([(i, t, h, "z") for i, h, t in rows], "doc_id long, text string, source string, host string")
    got = Counter((r.doc_id, r.text, r.n_lines_dropped) for r in L.clean(df, 0.2, 1.5).collect())
    assert got == brute(rows, 0.2, 1.5)
    assert L.clean(df, 0.2, 1.5).columns == ["doc_id", "text", "source", "host", "n_lines_dropped"]
    assert L.clean(df.limit(0)).collect() == []


def test_few_pages_and_long_texts(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(i, "four", f"Menu bar\nstory {i}") for i in range(4)] + [(10, "one", "Menu bar\nalone"), (20, "two", "Menu bar\na"), (21, "two", "Menu bar\nb")] + [(30, "long", "Menu bar\n" + long), (31, "long", "Menu bar\nz")]
    df = spark.createDataFrame([(i, t, h, 1, "x") for i, h, t in rows], "doc_id long, text string, source string, _lines int, _host string")
    got = L.clean(df)
    assert got.columns == ["doc_id", "text", "source", "_lines", "_host", "n_lines_dropped"]
    assert {r.doc_id: r.n_lines_dropped for r in got.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 10: 0, 20: 1, 21: 1, 30: 1, 31: 1}
    assert Counter((r.doc_id, r.text, r.n_lines_dropped) for r in got.collect()) == brute(rows, L.RATIO, L.SURE)


def test_table(spark):
    for data in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
        got = Counter(tuple(r) for r in L.query(spark, data).collect())
        assert got == brute(rows, L.RATIO, L.SURE)
    assert any(k[2] for k in got)
