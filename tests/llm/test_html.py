import html
import re

from canopy.llm import html_blocks as H

DATA = "/root/testdata/sf0.01"
TREE = H.train()


def text(page):
    return H.main_text(TREE, page)


def test_tree_asks_for_neighbours_and_holds_on_other_pages():
    assert {"words_before", "links_before", "words_after"} <= H.used(TREE)
    wrong = total = 0
    for page in H.labelled(seed=99, n=440):
        rows, labels = H.rows_of(page)
        wrong += sum(H.is_main(TREE, r) != y for r, y in zip(rows, labels))
        total += len(labels)
    assert wrong < 0.01 * total


BODY = "<h1>Title</h1><p>One two three four five six seven eight nine.<p>Short."
WANT = "Title\n\nOne two three four five six seven eight nine.\n\nShort."


def test_templates():
    menu = "<a href=1>Home</a> <a href=2>News</a>"
    for page in (
        f'<nav>{menu}</nav><article class="overflow-hidden">{BODY}</article><footer>us</footer>',
        f'<article id="cookies">{BODY}</article>',
        f"<header><h1>Site</h1></header><main>{BODY}</main><footer>{menu}</footer>",
        f"<div class=menu>{menu}</div><div class=content>{BODY}</div><div class=footer>{menu}</div>",
        f"<div>{menu}</div><div>{BODY}</div><div>{menu}</div>",
        f"<form id=aspnet><div>{menu}</div><div>{BODY}</div><div>{menu}</div></form>",
        f"<div class='with-sidebar widget'><article>{BODY}</article></div><aside>More of it</aside>",
        f"<nav>{menu}</nav><article>{BODY}</article><section><h2>Reader remarks</h2><p>Great text, dear author, thank you for it.</section>",
        f"<nav>{menu}</nav><article>{BODY}<section><h2>Reader remarks</h2><p>Great text, dear author, thank you for it.</section></article>",
        f"<article>{BODY}<div class='user-feedback'><p>Great text, dear author, thank you for it.</div></article>",
        f"<article>{BODY}<article><p>I do not agree with the author on this.</article></article><footer>us</footer>",
        f"<title>Never closed<body><article>{BODY}</article>",
        f"<!-- never closed <article>{BODY}</article>",
        f"<article>{BODY.replace('<h1>Title</h1>', '<div class=post-header><h1>Title</h1></div>')}</article>",
        f"<article class=keep>{BODY}</article><nav class=keep>{menu}</nav>",
    ):
        assert text(page) == WANT, page
    inner = f"<article>{BODY}<div class='col side'><p>Also a part of the article, which stands beside it.</div></article>"
    assert text(inner) == WANT + "\n\nAlso a part of the article, which stands beside it."


def test_odd_pages_take_linear_time():
    import time

    for page in ("<title>" * 100_000 + "<!--" * 100_000, "<a " * 100_000, "<div>" * 50_000 + "x" + "</p>" * 5_000, "<nav>a" * 20_000):
        began = time.time()
        text(page)
        assert time.time() - began < 5


def test_cases():
    assert text(None) == text("") == text("<html></html>") == text("<!-- only -->") == ""
    page = """<html><head><title>T</title><script>if (a < b) { "</p>" }</script><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">x</a></nav>
      <div class="cookie-banner">We use cookies</div><article><h1>Head  line</h1><p>One &amp; two&nbsp;three<br>four <b>five</b>six</p><p title="a > b">a < b &lt;p&gt; &#233;&copy</p>
      <ul><li>Item</li></ul><aside>no</aside><form>mail<input></form><div class="ad">Buy</div><!-- x --><div class="comments"><p>Me too</p></div><p>El.</p></article>
      <section id="comments"><p>Great text, dear author, thank you for it.</p></section><div class="sidebar"><p>More of this from us</p></div><footer>&copy; us</footer></body></html>"""
    assert text(page) == "Head line\n\nOne & two three four fivesix\n\na < b <p> é©\n\nItem\n\nEl."
    assert text("<article><p class=notice>Note this<p>Kept<p class='x'>Also</article>") == "Kept\n\nAlso"
    assert text("<article><p>Unclosed <b>bold<p>Next one") == "Unclosed bold\n\nNext one"
    assert text("<article><p>quote ' in <a title='x>y' href=\"q\">text</a> " + "word " * 50000 + "</p>").count("word") == 50000
    assert text("<p>plain < text with an open bracket & nothing else <") == "plain < text with an open bracket & nothing else <"


def test_pages_of_table(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in H.query(spark, DATA).collect():
        inner = re.search("<article>(.*?)</article>", rows[r.page_id].html, re.S)[1]
        parts = re.split("</?(?:h1|p)>", re.sub("</?b>", "", inner.replace("<br>", " ")))
        want = "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert (r.text, r.n_chars, r.url) == (want, len(want), rows[r.page_id].url)


def test_nulls_and_columns(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, "u", "", "t"), (None, "u", "<p>Some words on a page here.", None)], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in H.extract(df).collect()] == [(1, None, ""), (1, "u", ""), (None, "u", "Some words on a page here.")]
    assert H.extract(df.limit(0)).collect() == []
