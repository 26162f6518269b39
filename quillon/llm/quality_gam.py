"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is summed up in ``FEATURES`` numbers. Features are cut into quantile bins; cyclic boosting then
fits a shallow tree on one feature at a time to the gradient of the logistic loss, and adds its leaves to
that feature's lookup table; afterwards the strongest feature pairs get tables of their own the same way.
A score is the logistic of the intercept plus one table entry per feature and pair.

The model is fitted on the driver on ``MAX_TRAIN`` labelled rows at most; scoring runs over all rows in
Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_sample, table, without

#: Labelled rows to fit on, about and at most: those of least hash of their id.
MAX_TRAIN = 20_000
MAX_BINS = 32
PAIR_BINS = 8
N_PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
LEAF_WEIGHT = 5.0
L2 = 2.0

FEATURES = ("log_words", "word_length", "symbols", "digits", "punctuation", "capitals", "distinct_words", "distinct_triples", "adjacent_repeats", "symbol_ends", "bare_marks", "shouted", "distinct_lines", "words_a_line", "short_words")
_SYMBOLS = b"#*$%&|<>=~^_{}[]\\@+"
_PUNCTUATION = b".,;:!?\"'()-/"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_ODD_END = frozenset(b"#*$%&|<>=~^_{}[]\\@+!")


def features(text: str | None) -> list[float]:
    """The numbers of ``FEATURES``; null and blank texts have zeros but for the shares of distinct items, 1."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    chars = sum(map(len, words))
    share = lambda kind: 1 - len(raw.translate(None, kind)) / len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lower = raw.upper().split()
    return [
        math.log1p(n),
        chars / n,
        share(_SYMBOLS),
        share(_DIGITS),
        share(_PUNCTUATION),
        share(_CAPITALS),
        len(set(words)) / n,
        len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(w[-1] in _ODD_END for w in words) / n,
        sum(len(w) == 1 and w in b"|-*#>" for w in words) / n,
        sum(a == b and len(a) > 1 for a, b in zip(words, lower)) / n,
        len(set(lines)) / len(lines),
        n / len(lines),
        sum(len(w) < 4 for w in words) / n,
    ]


@dataclass
class Additive:
    """Bin edges, lookup tables and pair tables; plain arrays, so that it travels with the scoring function."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for (a, b), values in zip(self.pairs, self.pair_tables):
                total += values[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + L2)


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values of a tree over ordered bins, of gradient and hessian sums by bin."""
    value = np.full(len(g), g.sum() / (h.sum() + L2))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
        gain[(hl * 4 < LEAF_WEIGHT) | ((h.sum() - hl) * 4 < LEAF_WEIGHT)] = 0
        if gain[k := int(np.argmax(gain))] > 1e-9:
            value = np.concatenate([_leaves(g[: k + 1], h[: k + 1], depth - 1), _leaves(g[k + 1 :], h[k + 1 :], depth - 1)])
    return value


def _pair_leaves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree that cuts rows once and then columns once on either side, with its gain."""
    best, value = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum())
    for cut in range(1, g.shape[0]):
        gain, parts = -whole, []
        for rows in (slice(0, cut), slice(cut, None)):
            leaf = _leaves(g[rows].sum(axis=0), h[rows].sum(axis=0), 1)
            sums = [(g[rows][:, leaf == v].sum(), h[rows][:, leaf == v].sum()) for v in np.unique(leaf)]
            gain += sum(_gain(a, b) for a, b in sums)
            parts.append(np.tile(leaf, (g[rows].shape[0], 1)))
        if gain > best + 1e-9:
            best, value = float(gain), np.concatenate(parts)
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits the model. Without rows it scores 0.5 everywhere; with one class only, near that class."""
    model = Additive()
    if not len(y):
        return model
    p = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(p / (1 - p)))
    model.edges = [_edges(x[:, j], MAX_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            k = len(model.tables[j])
            step = RATE * _leaves(np.bincount(b, g, k), np.bincount(b, h, k), 2)
            model.tables[j] += step
            total += step[b]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        g, h = slopes()
        cell = coarse[a] * shape[1] + coarse[b]
        return tuple(np.bincount(cell, s, shape[0] * shape[1]).reshape(shape) for s in (g, h))

    gains = sorted(((-_pair_leaves(*sums(a, b))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)))
    model.pairs = [(a, b) for gain, a, b in gains[:N_PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (a, b) in enumerate(model.pairs):
            step = RATE * _pair_leaves(*sums(a, b))[1]
            model.pair_tables[t] += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """Ids of a third of all documents, whose labels are never learnt from. A null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Additive:
    """Fits on about ``max_rows`` labelled ids at most, outside the held-out third, and on one document of each:
    of several of an id, that of the least hash. Contradicting labels of an id count as bad; null labels and ids
    are ignored."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = bounded_sample(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), max_rows, 5)
    measure = F.pandas_udf(lambda text: pd.Series([features(t) for t in text]), "array<double>")
    # bounded by max_rows, as is the number of groups
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), measure("text").alias("x"))
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "x")).alias("of")).select("doc_id", "quality", "of.x")
    got = sorted(one.collect())
    return fit(np.array([r["x"] for r in got], dtype=float).reshape(-1, len(FEATURES)), np.array([float(r["quality"] > 0) for r in got]))


def score_of(model: Additive) -> Callable[[Column], Column]:
    """The model as a function of a text column."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))

    return scored


def keep_quality(docs: DataFrame, model: Additive) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns."""
    return docs.where(score_of(model)(F.col("text")) >= 0.5)


def score_quality(docs: DataFrame, model: Additive) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, of the text alone) and ``predicted`` (1 if score >= 0.5, else 0).

    Null texts score as empty ones. Equal texts score equally, texts are read whole, an empty table stays
    empty; input columns of the added names are replaced."""
    out = without(docs, "score", "predicted").withColumn("score", score_of(model)(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return score_quality(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
