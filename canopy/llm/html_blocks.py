"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is read once, tag by tag, into a flat list of text blocks. A block is described by its own
words and link density and those of the blocks before and after it, by the elements it stands in
(article, main, menus, forms), by whether the class or id of an element around it names an advert,
a sidebar or the like and how much of the page that element holds, and by whether it follows a
heading over readers' remarks. No single mark is a verdict: a decision tree over these features,
grown on the labelled pages of labelled(), says which blocks are main text.

Cases: null or empty html gives an empty text; a page without a main block gives an empty text;
unclosed tags, comments and scripts, stray `<`, quotes in attributes and tags inside scripts are
tolerated; a title, script or the like without an end ends at the next tag; a very long page is
read whole, in time proportional to its length, and the batch that holds it is as long as it is;
rows are independent, so ties, repeated rows and empty tables need no care; extra columns are kept
by extract() unless they take the result's name.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
#: Elements whose content is no text of the page.
OPAQUE = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea select svg iframe title object math canvas audio video".split()}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody tfoot thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th img input button label option".split())
#: Elements of what isn't main text; a header inside an article may hold its title.
AWAY = frozenset("nav menu footer aside form header dialog button fieldset search".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
KINDS = {"li": 1, "dd": 1, "dt": 1, "p": 2, "pre": 2, "blockquote": 2}
#: Parts of a class or id that often stand on what isn't main text.
NAMED = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|nav\w*|menu|footer|masthead|topbar|sidebar|rail|related|recommend\w*|share|sharing|social|cookies?|consent|gdpr|notice|alert|popup|modal"
    r"|comments?|commentlist|remarks|repl(?:y|ies)|feedback|disqus|respond|breadcrumbs?|newsletter|subscri\w*|signup|login|widget|legal|copyright|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
REMARKS = re.compile(r"\b(?:comments?|remarks|repl(?:y|ies)|responses|feedback)\b|\b(?:readers?|visitors?|users?)\b.*\b(?:say|said|think|write|wrote|opinions?|reactions?|voices)\b|\bjoin the (?:discussion|conversation)\b", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "page_has", "away", "away_share", "named", "named_share", "remark", "kind")


class State:
    """What the elements that are open say of the text in them."""

    __slots__ = ("tag", "inside", "away", "away_id", "named", "named_id", "remark")

    def __init__(self, tag, inside=0, away=0, away_id=0, named=0, named_id=0, remark=0):
        self.tag, self.inside, self.away, self.away_id, self.named, self.named_id, self.remark = tag, inside, away, away_id, named, named_id, remark


def blocks(page: str) -> tuple[list[tuple], list[int]]:
    """The blocks, each (text, words, linked words, inside, away, away element, named, named element,
    remark, kind), and of each element of note the number of the one around it.

    inside: 1 main, 2 article, 3 an article in an article; away: 1 an article's header, 2 other
    elements of AWAY; kind: 1 list item, 2 paragraph, 3 heading."""
    out: list[tuple] = []
    text: list[str] = []
    linked: list[str] = []
    around = [0]  # element 0 is the page
    stack = [State("")]
    link_at, kind, level, last, pos, n = 0, 0, 0, 0, 0, len(page)
    endless: set[str] = set()
    tags_to = page.rfind(">") + 1
    opened: dict[str, int] = {}

    def flush():
        nonlocal text, linked
        if text:
            raw = "".join(text)
            whole = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if whole:
                s = stack[-1]
                if kind == 3:
                    if len(whole) < 80 and REMARKS.search(whole):
                        s.remark = level
                    elif s.remark and level <= s.remark:
                        s.remark = 0
                out.append((whole, whole.count(" ") + 1, len(" ".join(linked).split()) if linked else 0, s.inside, s.away, s.away_id, s.named, s.named_id, int(s.remark > 0), kind))
            text, linked = [], []

    def say(piece):
        if piece:
            text.append(piece)
            if link_at:
                linked.append(piece)

    while m := TOKEN.search(page, pos, tags_to):
        at = m.start()
        say(page[last:at])
        last = pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page.startswith("<!--", at):
                end = page.find("-->", pos) if "--" not in endless else -1
                if end < 0:  # a comment without an end is taken for a tag
                    endless.add("--")
                    end = page.find(">", pos) - 2
                last = pos = end + 3 if end + 3 > pos else n
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", pos) if "]]" not in endless else -1
                if end < 0:
                    endless.add("]]")
                else:
                    say(page[pos:end].replace("&", "&amp;"))
                    last = pos = end + 3
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in OPAQUE:
            if not closing and not attrs.endswith("/"):
                end = OPAQUE[tag].search(page, pos) if tag not in endless else None
                if end:
                    last = pos = end.end()
                else:  # without an end, it ends where the next tag begins
                    endless.add(tag)
                    nxt = TOKEN.search(page, pos, tags_to)
                    last = pos = nxt.start() if nxt else n
            text.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        elif tag in SPACED:
            text.append(" ")
        if closing:
            if tag == "a":
                link_at = 0
            elif tag in HEADINGS or tag in KINDS:
                kind = link_at = 0
            if opened.get(tag):
                while True:
                    gone = stack.pop().tag
                    opened[gone] -= 1
                    if gone == tag:
                        break
                if link_at > len(stack):  # a link ends with the element that it began in
                    link_at = 0
            continue
        if block and stack[-1].tag == "p":
            stack.pop()
            opened["p"] -= 1
        if tag == "a":
            link_at = len(stack)
        elif tag in HEADINGS:
            kind, level = 3, HEADINGS[tag]
        elif tag in KINDS:
            kind = KINDS[tag]
        elif block:
            kind = 0
        if tag in VOID or attrs.endswith("/") or not (block or tag == "button"):
            continue
        s = stack[-1]
        new = State(tag, s.inside, s.away, s.away_id, s.named, s.named_id, s.remark)
        says = tag in AWAY or tag in ("article", "main", "div", "section")
        if tag == "main" and s.inside == 0:
            new.inside = 1
        elif tag == "article":
            new.inside = 2 if s.inside < 2 else 3
        elif tag in AWAY:
            new.away = max(s.away, 1 if tag == "header" and s.inside else 2)
            new.away_id = len(around)
            around.append(max(s.away_id, s.named_id))
        if attrs and tag not in ("body", "html"):
            if any(NAMED.search(x[1] or x[2] or x[3] or "") for x in NAMES.finditer(attrs)) or ("idden" in attrs and HIDDEN.search(QUOTED.sub("", attrs) if "aria" not in attrs.lower() else attrs)) or ("none" in attrs and HIDDEN.search(attrs)):
                says = True
                new.named, new.named_id = 1, len(around)
                around.append(max(s.away_id, s.named_id, new.away_id if new.away_id != s.away_id else 0))
        if says:
            stack.append(new)
            opened[tag] = opened.get(tag, 0) + 1
    say(page[last:])
    flush()
    return out, around


def features(found: list[tuple], around: list[int]) -> list[tuple]:
    """A row of FEATURES for each block."""
    held, n = [0] * len(around), len(found)
    for b in found:
        held[max(b[5], b[7])] += b[1]
    for i in range(len(around) - 1, 0, -1):  # an element's number is higher than that of the one around it
        held[around[i]] += held[i]
    total = max(1, sum(b[1] for b in found))
    # An article among menus or adverts doesn't make a page one of articles.
    has = max([0] + [min(b[3], 2) for b in found if b[4] < 2 and (not b[6] or held[b[7]] > total / 2)])
    rows, none = [], (None, 0, 0)
    for i, (_, words, links, inside, away, away_id, named, named_id, remark, kind) in enumerate(found):
        p, q = found[i - 1] if i else none, found[i + 1] if i + 1 < n else none
        rows.append((words, links / words, p[1], p[2] / p[1] if p[1] else 0.0, q[1], q[2] / q[1] if q[1] else 0.0, inside, has, away, held[away_id] / total, named, held[named_id] / total, remark, kind))
    return rows


#: Words of the labelled pages; what they say doesn't matter to the tree.
LONG = (
    "The bridge was opened on Monday by the mayor of the city, after it had been closed for years.",
    "More than two hundred people came to see it, though the rain didn't stop until the evening.",
    "Whales sing to each other, and their songs travel for hundreds of miles through the deep water.",
    "Mix flour, water and salt, let the dough rest for a night, and bake it in a very hot oven.",
    "Nobody knew who had written the letter, which lay on the table when we came home that night.",
    "Plant beans in May and water them each evening, unless it has rained enough during the day.",
    "It is said that the old tower was built by three brothers, of whom the last one never saw it done.",
)
SHORT = ("It rained.", "Yes.", "Why not?", "Salt, yeast, water", "Call me.", "A week later", "Blue whale", "Nothing else", "One, two, three")
TITLES = ("A new bridge", "On whales", "Bread at home", "Garden notes for the spring", "The letter", "What the tower saw and what it didn't")
MENU = ("Home", "News", "Sport", "Weather", "About us", "Contact", "Terms of use", "Privacy", "Log in", "All articles")
ASIDE = (
    "Sign up for our letter and get all that happened each Sunday.", "We use cookies to make this site better for you. By staying you agree to that.", "Buy two shoes and pay for one, this week only.", "Ten ways to sleep better, as told by a doctor who never sleeps.",
    "About the author, who lives by the sea with two dogs and a cat.", "Share this", "Cheap flights to all islands in the sun, book now and save.", "Written by the staff", "You may also like the secret life of the octopus.",
)
REPLIES = ("I tried this and my family loved it, thank you so much for writing it down for all of us.", "First!", "I do not agree with the author on this, because of what I have read elsewhere.", "Nice.", "What about peas, do they need as much water as the beans do?")
MARK = "\ue000"  # begins each block that is main text


def labelled(seed: int = 0, n: int = 660) -> list[str]:
    """Small labelled pages of eleven layouts: blocks of main text begin with MARK."""
    r = random.Random(seed)
    pick, some = r.choice, lambda xs, a, b: [r.choice(xs) for _ in range(r.randint(a, b))]

    def main(title=True):
        out = [f"<{pick(['h1', 'h1', 'h2', 'div'])}>{MARK}{pick(TITLES + SHORT)}</h1></h2></div>"] if title and r.random() < 0.8 else []
        for _ in range(pick([1, 1, 2, 2, 3, 4, 5, 6, 7])):
            k = r.random()
            if k < 0.55:
                t = " ".join(some(LONG, 1, pick([2, 3, 12])))
                out.append(f"<p>{MARK}{t}" + (f" <a href=x>{pick(TITLES)}</a>" if r.random() < 0.2 else ""))
            elif k < 0.8:
                out.append(f"<p>{MARK}{pick(SHORT)}</p>")
            elif k < 0.9:
                out.append("<ul>" + "".join(f"<li>{MARK}{x}" for x in some(SHORT + LONG, 2, 4)) + "</ul>")
            else:
                out.append(f"<h2>{MARK}{pick(TITLES)}</h2><p>{MARK}{pick(LONG)}</p>")
        if r.random() < 0.3:
            i = r.randrange(len(out) + 1)
            out.insert(i, f"<div class='{pick(['overflow-hidden', 'col side', 'text', 'wide', 'post-header', 'box'])}'><p>{MARK}{pick(LONG)}</p></div>")
        return "".join(out)

    def links():
        return " ".join(f"<a href=/{i}>{x}</a>" for i, x in enumerate(some(MENU, 1, 6)))

    def menu():
        return pick([lambda: "<ul>" + "".join(f"<li><a href=/>{x}</a>" for x in some(MENU, 2, 7)) + "</ul>", lambda: f"<p>{links()}</p>", links])()

    def junk():
        return pick([f"<p>{pick(ASIDE)}</p>", pick(ASIDE), f"<h3>{pick(TITLES)}</h3><p>{pick(ASIDE)}", f"<a href=/>{pick(ASIDE)}</a>", f"<p>{pick(LONG)}</p>", pick(SHORT)])

    def replies():
        return "".join(f"<p>{x}</p>" for x in some(REPLIES + LONG, 1, 6))

    def named(inner, extra=()):
        return f"<{pick(['div', 'section'])} class='{pick(['ad', 'sidebar', 'related', 'cookie-notice', 'newsletter', 'share', 'promo-box', 'notice', 'sponsored', *extra])}'>{inner}</div></section>"

    def remarks():
        head = pick(["Comments", "Reader remarks", "3 replies", "Leave a comment", "What readers think", "Responses", "Reader feedback"])
        return f"<section><h2>{head}</h2>{replies()}</section>"

    def away():
        return pick([f"<nav>{menu()}</nav>", f"<aside>{junk()}</aside>", f"<footer>{junk()} {links()}</footer>", f"<form>{junk()}<input></form>", named(junk()), f"<header><h1>{pick(TITLES)}</h1>{menu()}</header>"])

    def foot():
        return f"<p>{pick(['All rights reserved', 'Written by the webmaster', 'Last changed on a Tuesday', 'Printed on paper'])}</p>" if r.random() < 0.5 else ""

    def page(k):
        if k == 0 and r.random() < 0.3:  # a short article beside much else
            much = " ".join(some(LONG, 1, 6))
            other = pick([named(much), named(f"<p>{much}</p>"), f"<aside>{much}</aside>", f"<div>{much}</div>", f"<div class=comments>{replies()}{replies()}</div>", remarks()])
            body = "".join(f"<p>{MARK}{x}</p>" for x in some(SHORT, 1, 3))
            return pick([f"<nav>{menu()}</nav>", ""]) + pick(["{0}{1}", "{1}{0}"]).format(other, f"<article><h1>{MARK}{pick(TITLES + SHORT)}</h1>{body}</article>") + pick([f"<footer>{junk()}</footer>", ""])
        if k == 0:  # article among menus
            return f"<header><h1>{pick(TITLES)}</h1>{menu()}</header><nav>{menu()}</nav>{named(junk())}<article class='{pick(['', 'overflow-hidden', 'post'])}' id='{pick(['a1', 'cookies', 'promo-2024'])}'>{main()}</article>{away()}<footer>{junk()}</footer>"
        if k == 1:  # article with things in it
            parts = [main(), away(), main(False), away() if r.random() < 0.5 else "", named(replies(), ["comments", "user-feedback", "replies"])]
            top = f"<header><h1>{MARK}{pick(TITLES)}</h1></header>" if r.random() < 0.4 else f"<div class=post-header><h1>{MARK}{pick(TITLES)}</h1></div>"
            return f"<nav>{menu()}</nav><article>{top}{''.join(parts)}</article><footer>{junk()}</footer>"
        if k == 2:  # main without an article
            more = f"{away()}{main(False)}{remarks()}" if r.random() < 0.6 else ""
            return f"{named(junk())}<main>{main()}{more}</main>{remarks() if r.random() < 0.3 else ''}<footer>{menu()}</footer>"
        if k == 3:  # telling names only
            return f"<div class=menu>{menu()}</div><div class=content>{main()}</div><div class='{pick(['comments', 'user-feedback', 'replies'])}'>{replies()}</div><div class=footer>{junk()}</div>"
        if k == 4:  # words and links only
            return f"{menu()}<div>{main()}</div><div>{menu()}{foot()}</div>"
        if k == 5:
            return f"<div><p>{links()}</p></div>{main()}<p>{links()}</p>" + (f"<p>{links()}</p>" if r.random() < 0.5 else "")
        if k == 6:  # a telling name on a wrapper
            body = f"<article>{main()}</article>{away()}" if r.random() < 0.5 else f"{main()}{main(False)}{main(False)}{menu()}"
            return f"<div class='{pick(['page nav-fixed', 'with-sidebar has sidebar', 'comments open', 'widget', 'modal'])}'>{body}</div>" + (f"<footer>{links()}</footer>" if r.random() < 0.5 else "")
        if k == 7:  # remarks without a telling class
            inner = remarks()
            if r.random() < 0.5:
                return f"<nav>{menu()}</nav><article>{main()}{inner}</article><footer>{junk()}</footer>"
            return f"<nav>{menu()}</nav><article>{main()}</article>{inner}<div>{replies()}</div>{away()}"
        if k == 8:  # replies as articles in the article, and several articles
            if r.random() < 0.5:
                return f"<article>{main()}{''.join(f'<article>{replies()}</article>' for _ in range(r.randint(1, 3)))}</article>{away()}"
            return f"<header>{menu()}</header><article>{main()}</article><article>{main()}</article><div class=sidebar><article><p>{pick(ASIDE)}</p></article></div><footer>{junk()}</footer>"
        if k == 9:  # nothing but text
            tag = pick(["article", "main", "div", "article class=overflow-hidden", "article id=cookies", "div class=content"])
            return f"<{tag}>{main()}</article></main></div>"
        return f"<form id=page>{menu()}<div>{main()}{main(False)}{main(False)}</div>{menu()}{foot()}</form>"  # a form around it all

    return [page(i % 11) for i in range(n)]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 2) -> tuple:
    """A tree by Gini impurity: a leaf (label,) or (feature, threshold, left, right); left is <=."""
    if depth == 0 or y.min() == y.max() or len(y) < 2 * least:
        return (int(2 * y.sum() > len(y)),)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(y) - at - 1 >= least)]
        if not len(at):
            continue
        n1, p1 = at + 1.0, pos[at].astype(float)
        n2, p2 = len(y) - n1, pos[-1] - p1
        cost = p1 * (1 - p1 / n1) + p2 * (1 - p2 / n2)
        i = int(cost.argmin())
        if best is None or cost[i] < best[0] - 1e-9:
            best = (cost[i], f, (v[at[i]] + v[at[i] + 1]) / 2)
    if best is None:
        return (int(2 * y.sum() > len(y)),)
    _, f, t = best
    left = x[:, f] <= t
    return (f, float(t), grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def rows_of(page: str) -> tuple[list[tuple], list[int]]:
    """Features and labels of a labelled page."""
    found, around = blocks(page)
    labels = [int(MARK in b[0]) for b in found]
    return features(found, around), labels


def train(pages: list[str] | None = None) -> tuple:
    x, y = [], []
    for page in labelled() if pages is None else pages:
        rows, labels = rows_of(page)
        x += rows
        y += labels
    return grow(np.array(x, float), np.array(y))


def used(tree: tuple) -> set[str]:
    """The features that a tree asks for."""
    return {FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if len(tree) > 1 else set()


def is_main(tree: tuple, row: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(tree: tuple, page: str | None) -> str:
    found, around = blocks(page) if page else ([], [0])
    return "\n\n".join(b[0] for b, row in zip(found, features(found, around)) if is_main(tree, row))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text in text_col, html left out."""
    tree = train()
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    at, places = pages.columns.index(html_col), [pages.columns.index(c) for c in kept]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(text_col, T.StringType())])

    def run(batches):
        for some in common.slices(batches, at):
            texts = [main_text(tree, x) for x in some.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(i) for i in places] + [pa.array(texts, pa.string())], schema.names)

    return common.in_arrow(pages, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
