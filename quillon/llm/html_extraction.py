"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of its block elements; text that stands in a container, beside its blocks or
without any, is a node of its own. Every node is main text or not: its own features (tag,
words in class and id, links, length, sentences and share of text) give its potential, and parent and child are tied by a
potential that depends on the child's kind of tag. Sum-product messages, once up and once down the tree,
give each node's marginal; the text of nodes with a marginal of one half or more is kept. The weights
maximise the conditional likelihood of labelled pages, with gradients from the same messages.

Many pages are one forest: messages pass level by level in numpy.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table, without
from quillon.llm.labelled_pages import pages as labelled_pages

TRAIN_PAGES = 500
STEPS = 250
RATE = 0.08
L2 = 0.002
#: Pages are taken together up to so many characters.
FOREST_CHARS = 2_000_000

# Kinds of elements.
KINDS = {
    "article": "article main", "nav": "nav menu", "header": "header hgroup", "footer": "footer", "aside": "aside dialog", "form": "form fieldset legend label",
    "heading": "h1 h2 h3 h4 h5 h6", "paragraph": "p", "list": "ul ol dl dir", "item": "li dt dd", "table": "table thead tbody tfoot tr td th caption",
    "box": "div section center details summary address", "quote": "blockquote pre figure figcaption", "root": "html body", "text": "",
}
#: Elements that hold their text themselves. Text in other ones makes a node of its own, of kind text.
HOLDERS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption label legend summary address".split())
#: Words in class, id and role, by what they tell.
NAMES = {
    "main": "article content post entry story body main text", "menu": "nav menu navigation navbar breadcrumb breadcrumbs", "head": "header masthead banner logo",
    "foot": "footer copyright foot", "side": "sidebar aside widget related recommended side", "ad": "ad ads advert advertisement sponsor sponsored promo",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe", "comments": "comment comments reply replies discussion disqus", "share": "share social follow",
    "form": "search login signup form",
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
#: What a page never shows: copies to be filled in, and what stands in for an embedded page. Other elements without a
#: kind, controls among them, hand their text to their parent.
SKIPPED = frozenset("template iframe".split())
#: Elements without a kind whose text stands apart from the one before.
APART = frozenset("br option optgroup select datalist".split())
_KIND = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
_TEXT = list(KINDS).index("text")
_NAME = {w: k for k, words in enumerate(NAMES.values()) for w in words.split()}
#: Opening one of the first closes an open one of the second, unless a third stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LABEL = re.compile(r'data-y="([01])"')
N_KINDS, N_NAMES = len(KINDS), len(NAMES)
N_FEATURES = 1 + N_KINDS + N_NAMES + 16
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


@dataclass
class Tree:
    """Nodes in page order, parents before children; runs of text with the node that holds each."""

    parent: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    names: list[list[int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    sentences: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str | None) -> Tree:
    """A page's tree of block elements; never fails, whatever the markup."""
    t, html = Tree(), html or ""
    stack: list[tuple[str, int]] = []
    run: list[str] = []
    links = 0  # open anchors
    link_words = 0

    def add(tag: str, attrs: str, kind: int | None = None) -> None:
        parent = stack[-1][1] if stack else -1
        names = sorted({_NAME[w] for m in _NAMED.finditer(attrs) for w in re.findall(r"[a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w in _NAME}) if attrs else []
        y = _LABEL.search(attrs) if attrs else None
        t.label.append(int(y[1]) if y else t.label[parent] if parent >= 0 else 0)
        t.parent.append(parent)
        t.kind.append(_KIND[tag] if kind is None else kind)
        t.depth.append(t.depth[parent] + 1 if parent >= 0 else 0)
        t.names.append(names)
        t.words.append(0)
        t.linked.append(0)
        t.sentences.append(0)
        if kind is None:
            stack.append((tag, len(t.parent) - 1))

    def flush() -> None:
        nonlocal link_words
        if run and (text := " ".join(html_.unescape("".join(run)).split())):
            if not stack:
                add("body", "")
            if stack[-1][0] not in HOLDERS:
                add("", "", _TEXT)
                at = len(t.parent) - 1
            else:
                at = stack[-1][1]
            t.runs.append((at, text))
            t.words[at] += text.count(" ") + 1
            t.linked[at] += link_words
            t.sentences[at] += len(_SENTENCE.findall(text))
        run.clear()
        link_words = 0

    def text(piece: str) -> None:
        nonlocal link_words
        if piece:
            run.append(piece)
            if links:
                link_words += len(piece.split())

    at = 0
    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW or tag in SKIPPED:
            if not closing and not (attrs.endswith("/") and tag in SKIPPED):
                if end := _end_of(tag).search(html, at):
                    at = end.end()
                elif tag in RAW:
                    at = len(html)
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in VOID:
            if tag in APART:
                run.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in APART:
            run.append(" ")
        if tag not in _KIND:
            continue
        flush()
        links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag or (len(tag) == 2 and tag[0] == "h" and _KIND[stack[k][0]] == _KIND["h1"] and _KIND[tag] == _KIND["h1"]):
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stops:
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    break
        if tag in ("html", "body") and any(x == tag for x, _ in stack):
            continue
        if not stack and tag not in ("html", "body"):
            add("body", "")  # as it is implied
        add(tag, attrs)
    text(html[at:])
    flush()
    return t


@lru_cache(maxsize=16)
def _end_of(tag: str) -> re.Pattern:
    """The end tag of a name, whole, up to its end."""
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I | re.A)


def node_features(t: Tree) -> np.ndarray:
    n = len(t.parent)
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    x[:, 0] = 1
    x[np.arange(n), 1 + np.array(t.kind, dtype=np.int64)] = 1
    for i, names in enumerate(t.names):
        for k in names:
            x[i, 1 + N_KINDS + k] = 1
    words, linked, sentences = (np.array(v, dtype=float) for v in (t.words, t.linked, t.sentences))
    parent, kind = np.array(t.parent, dtype=np.int64), np.array(t.kind, dtype=np.int64)
    blocks = np.isin(kind, (_KIND["p"], _KIND["h1"], _KIND["pre"], _TEXT)).astype(float)
    for i in range(n - 1, 0, -1):  # sums over subtrees; children come after parents
        if (p := t.parent[i]) >= 0:
            words[p] += words[i]
            linked[p] += linked[i]
            sentences[p] += sentences[i]
            blocks[p] += blocks[i]
    share = linked / np.maximum(words, 1)
    all_words = max(1.0, words[parent < 0].sum())
    of_parent = words / np.maximum(np.where(parent >= 0, words[parent], all_words), 1)
    of_page = words / all_words
    base = 1 + N_KINDS + N_NAMES
    on = (
        words == 0, (words > 0) & (words <= 5), (words > 5) & (words <= 20), words > 20, words > 100, share > 0.5, share > 0.9, np.array(t.words) > 0,
        sentences == 0, sentences > 2, blocks > 1, (blocks > 1) & (share < 0.3), of_page > 0.25, of_page > 0.6, of_parent > 0.5, (kind == _KIND["h1"]) & (share < 0.5),
    )
    for k, column in enumerate(on):
        x[:, base + k] = column
    return x


@dataclass
class Forest:
    x: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]


def forest_of(trees: list[Tree]) -> Forest:
    offsets = np.cumsum([0, *(len(t.parent) for t in trees)])
    parent = np.concatenate([np.where(np.array(t.parent, dtype=np.int64) < 0, -1, np.array(t.parent, dtype=np.int64) + o) for t, o in zip(trees, offsets)] or [np.empty(0, np.int64)])
    depth = np.array([d for t in trees for d in t.depth], dtype=np.int64)
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    x = np.concatenate([node_features(t) for t in trees]) if trees else np.empty((0, N_FEATURES), np.float32)
    return Forest(x, parent, np.array([k for t in trees for k in t.kind], dtype=np.int64), np.split(order, cuts) if len(order) else [])


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(f: Forest, unary: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product: P(y = 1) of each node, and P(parent's y, own y) of each node with a parent.

    ``ties[kind, parent's y, own y]`` are log potentials."""
    n = len(f.parent)
    inside = np.zeros((n, 2))
    inside[:, 1] = f.x @ unary
    tie, up = ties[f.kind], np.zeros((n, 2))
    for level in f.levels[:0:-1]:
        up[level] = _log_sum(tie[level] + inside[level][:, None, :], 2)
        np.add.at(inside, f.parent[level], up[level])
    outside, pair = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        p = f.parent[level]
        rest = inside[p] + outside[p] - up[level]
        both = rest[:, :, None] + tie[level] + inside[level][:, None, :]
        outside[level] = _log_sum(rest[:, :, None] + tie[level], 1)
        pair[level] = np.exp(both - _log_sum(both.reshape(len(level), 4), 1)[:, None, None])
    belief = inside + outside
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pair


@lru_cache(maxsize=4)
def train(n_pages: int = TRAIN_PAGES, steps: int = STEPS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights and ties of greatest penalised likelihood on labelled pages, by Adam."""
    trees = [parse(p) for p in labelled_pages(n_pages, seed)]
    f = forest_of(trees)
    y = np.array([v for t in trees for v in t.label], dtype=float)
    child = np.flatnonzero(f.parent >= 0)
    truth = np.zeros((N_KINDS, 2, 2))
    np.add.at(truth, (f.kind[child], y[f.parent[child]].astype(int), y[child].astype(int)), 1)
    w = np.zeros(N_FEATURES + N_KINDS * 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        unary, ties = w[:N_FEATURES], w[N_FEATURES:].reshape(N_KINDS, 2, 2)
        p, pair = marginals(f, unary, ties)
        expected = np.zeros_like(truth)
        np.add.at(expected, f.kind[child], pair[child])
        g = np.concatenate([f.x.T @ (y - p), (truth - expected).ravel()]) / n_pages - L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:N_FEATURES], w[N_FEATURES:].reshape(N_KINDS, 2, 2)


def extract(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    trees = [parse(p) for p in pages]
    p, _ = marginals(forest_of(trees), *model)
    out, at = [], 0
    for t in trees:
        out.append("\n".join(text for node, text in t.runs if p[at + node] >= 0.5))
        at += len(t.parent)
    return out


def extract_pages(pages: DataFrame, n_pages: int = TRAIN_PAGES) -> DataFrame:
    """``pages`` with ``text`` (main text, blocks joined by a line feed) and ``n_chars`` (its code points).

    A null or empty page, and one without main text, gives an empty text. Text outside any block element is a block,
    up to the next block element; line breaks in it are white space. Text of controls outside forms is kept. Any markup is parsed as far as it
    goes, whole; equal pages give equal texts, an empty table stays empty; input columns named text or
    n_chars are replaced."""
    model = train(n_pages)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            out, some, chars = [], [], 0
            for h in htmls:
                some.append(h)
                chars += len(h or "")
                if chars >= FOREST_CHARS:
                    out += extract(some, model)
                    some, chars = [], 0
            yield pd.Series(out + extract(some, model), dtype=object)

    out = without(pages, "text", "n_chars").withColumn("text", extracted(F.col("html")))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
