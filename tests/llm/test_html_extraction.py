import html
import html as html_
import html.parser
import itertools
import random
import re

import numpy as np
import pytest

from quillon.llm import html_extraction as h
from quillon.llm.labelled_pages import pages
from tests.llm.helpers import SMALL

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model():
    return h.train()


def plain(page):
    a = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:h1|p)>", a[1]) if a else []
    return "\n".join(x for x in (" ".join(html_.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks) if x)


def test_query_extracts_every_article(spark):
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = h.op10_html_extraction(spark, SMALL).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_held_out_pages(model):
    trees = [h.parse(p) for p in pages(150, seed=77)]
    p, _ = h.marginals(h.forest_of(trees), *model)
    y = np.array([v for t in trees for v in t.label])
    text = np.array([v for t in trees for v in t.words]) > 0
    assert ((p >= 0.5) == y)[text].mean() > 0.99


def test_messages_give_exact_marginals():
    """Against the sum over all labellings of a small tree."""
    r = np.random.default_rng(3)
    t = h.parse("<body><div><p>a</p><p>b</p></div><article><h1>c</h1><div><p>d</p></div></article></body>")
    f = h.forest_of([t])
    unary, ties = r.normal(size=h.N_FEATURES), r.normal(size=(h.N_KINDS, 2, 2))
    p, pair = h.marginals(f, unary, ties)
    n, own = len(f.parent), f.x @ unary
    total, on, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(own[k] * y[k] for k in range(n)) + sum(ties[f.kind[k], y[f.parent[k]], y[k]] for k in range(n) if f.parent[k] >= 0))
        total += w
        on += w * np.array(y)
        for k in range(n):
            if f.parent[k] >= 0:
                both[k, y[f.parent[k]], y[k]] += w
    assert np.allclose(p, on / total) and np.allclose(pair, both / total)


def test_layouts(model):
    page = """<html><head><title>T</title></head><body class="x"><div id="masthead"><p>Site name</p></div><div class="menu"><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></div>
    <div class="content"><h1>Head &amp; line</h1><p>First  para<br>graph &lt;b&gt; with <a href="/">a link</a> in it.<p>Second &#233; one.<script>var x = "</p><p>no";</script>
    <div class="ad">Buy now! Buy now!</div><blockquote>Said so.</blockquote></div><aside><p>More to read on this</p></aside>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all.</p></div></section>
    <form class="search"><label>Search</label><input name=q></form><div class="cookie notice"><p>We use cookies here.</p></div><footer>&copy; us</footer></body></html>"""
    assert h.extract([page], model) == ["Head & line\nFirst para graph <b> with a link in it.\nSecond é one.\nSaid so."]


@pytest.mark.parametrize("page", ["<", "<<p>", "</p></div>", "<p", "<!-- <p>x", "<script>x", "<a href='>x", "<p a=\"<b>\">x</p>", "İ<style>p</style>x", "<html><html><body>y", "&#xZZ; &bogus; \x00"])
def test_parser_never_fails(page, model):
    h.extract([page, None, "", page * 50], model)


def test_parser_closes_what_html_closes():
    t = h.parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><p>h<div>i</div>j")
    assert [x for _, x in t.runs] == list("abcdefghij")
    kinds = list(h.KINDS)
    assert [kinds[t.kind[k]] for k, _ in t.runs] == ["item"] * 4 + ["table"] * 3 + ["paragraph", "text", "text"]
    assert [kinds[t.kind[t.parent[k]]] for k, _ in t.runs[-2:]] == ["box", "root"]


def test_raw_and_skipped_elements():
    t = h.parse("<body>a<script>if (x < y) {'</p>'}</SCRIPT >b<!-- c --><style>d</style><select><option>e<option>f</select>g<template><p>no</p></template>h<iframe>i<br/>j")
    assert " ".join(x for _, x in t.runs) == "ab e f ghi j"


TWO = "<p>First of the long paragraphs, with a number of words in it. It says a thing or two.</p><p>Second of the long ones. It goes on about the matter for a while, and ends.</p>"
BOTH = "First of the long paragraphs, with a number of words in it. It says a thing or two.\nSecond of the long ones. It goes on about the matter for a while, and ends."

L = "Some lines of plain text stand here, without an element of their own. They say a thing or two, and then they end."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>T</title><body><article>{TWO}</article><header><p>Site</p></header>", BOTH), (f"<head><title>T</title><article><header><h1>Top</h1></header>{TWO}</article>", "Top\n" + BOTH),
        (f"<body><article>{TWO}<p>See <a href=/>all that was said of this matter before</a></p></article>", BOTH + "\nSee all that was said of this matter before"),
        ("<body><article><p><a href=/>All of it is a link, from the first word to the last one.</a></p></article>", "All of it is a link, from the first word to the last one."),
        (f"<body><div><h1>Head</h1>{TWO}</div></body>", "Head\n" + BOTH), (f"<body><div><ul><li><a href=/>Home</a><li><a href=/b>About us</a><li><a href=/c>Contact</a></ul></div><div class=k7><h2>Head</h2>{TWO}</div></body>", "Head\n" + BOTH),
        ("<article><p>One super<wbr>cali and fra<img src=x>gile word<br>each. It is so.</p></article>", "One supercali and fragile word each. It is so."),
        ("<article><p>A sum <math><mi>x</mi><mo>+</mo></math> in <svg><text>a drawing</text></svg> and <noscript>no script</noscript>. So it is.</p></article>", "A sum x+ in a drawing and no script. So it is."),
        ("<article><p>Words here. <script>a</scripty>b</script >And there, it ends.</p></article>", "Words here. And there, it ends."), ("<article><p>Press the <button>OK</button> key now, and choose <select><option>one<option>two</select> of them.</p></article>", "Press the OK key now, and choose one two of them."),
        (f"<body>{L}<br><br>{L}<br><br>{L}</body>", f"{L} {L} {L}"), (f"<body><h1>Top</h1>{L}</body>", "Top\n" + L), (f"<center><font>{L}</font></center>", L), (L, L), (f"<html><body>{L}", L),
        (f"<body><b>Top</b><br>{L}<p>{L}<hr>{L}</body>", f"Top {L}\n{L}\n{L}"), (f"<div>{L}<p>{L}</p>{L}</div>", f"{L}\n{L}\n{L}"),
        (f"<body><nav><a href=/>Home</a> <a href=/a>About</a></nav>{L}<footer>&copy; us</footer>", L),
        (f"<body><table><tr><td><ul><li><a href=/>Home</a><li><a href=/b>About us</a><li><a href=/c>Contact</a></ul></td><td>{L}<p>{L}</td></tr></table>", f"{L}\n{L}"),
        (f"<article><p>{L}</p><ul><li><a href=/a>The first source</a><li><a href=/b>The second one</a></ul><p>{L}</p></article>", f"{L}\nThe first source\nThe second one\n{L}"),
    ],
)
def test_pages_of_other_hands(page, text, model):
    assert h.extract([page], model) == [text]


def test_edge_cases(spark):
    long = "<article>" + "<p>Some words of text, and some more.</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", long), (4, "u", "<nav><a href=/>x</a></nav>"), (4, "u", "<nav><a href=/>x</a></nav>"), (None, "u", "<article><p>One.</p>\n\n<p> Two  parts </p></article>")]
    out = h.extract_pages(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS Text", "2 AS n_chars"))
    got = [(r.page_id, r.text, r.n_chars) for r in out.collect()]
    lines = "\n".join(["Some words of text, and some more."] * 20_000)
    assert got == [(1, "", 0), (2, "", 0), (3, lines, len(lines)), (4, "", 0), (4, "", 0), (None, "One.\nTwo parts", 14)]
    assert h.extract_pages(spark.createDataFrame([], PAGES)).collect() == []


class _Blocks(html.parser.HTMLParser):
    """Text of a page by blocks, without a model: for pages that hold main text only."""

    INLINE = {"b", "i", "a", "font", "span", "button", "em"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks = [[]]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag not in self.INLINE:
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.blocks.append([])

    def handle_data(self, data):
        self.blocks[-1].append(data)

    def text(self):
        return "\n".join(x for x in (" ".join("".join(b).split()) for b in self.blocks) if x)


def random_page(r):
    """A page of main text, in and outside of elements."""
    sentence = lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(r.randint(4, 16))).capitalize() + "."
    text = lambda: " ".join(sentence() for _ in range(r.randint(1, 5)))
    some = [
        text, lambda: f"<p>{text()}</p>", lambda: f"<p>{text()}", lambda: f"<font>{text()}</font>", lambda: f"{text()}<br><br>{text()}", lambda: f"{text()}<hr>{text()}",
        lambda: f"<div>{text()}</div>", lambda: f"<div>{text()}<p>{text()}</p>{text()}</div>", lambda: f"<p>{text()} Press the <button>OK</button> key. {text()}</p>", lambda: f"<blockquote>{text()}</blockquote>",
    ]
    body = "".join(r.choice(some)() for _ in range(r.randint(1, 8)))
    wrap = r.choice(["{}", "<body>{}</body>", "<html><body>{}", "<center>{}</center>", "<body><div>{}</div>", "<article>{}</article>", "<main>{}</main>"])
    return wrap.format(r.choice(["", "", "<h1>A title of some words</h1>"]) + body)


def test_pages_of_main_text_against_a_plain_extractor(model):
    r = random.Random(21)
    pages_ = [random_page(r) for _ in range(400)]
    got = h.extract(pages_, model)
    want = [_Blocks(p).text() for p in pages_]
    same = sum(a == b for a, b in zip(got, want))
    kept, all_ = sum(map(len, got)), sum(map(len, want))
    assert same >= 396 and kept >= 0.998 * all_
