"""Benchmark decontamination by a BM25 inverted index of the test items, searched with block-max WAND.

Every document is cut into overlapping passages, and every passage is a query. An item's BM25 impacts are
divided by what the item's own text would score, so that one threshold fits items of any length. Items are
indexed by length class; a class of items of up to W words is searched with passages of W words, one every
W / 2, so that some passage holds three quarters of an item wherever it stands. Block maxima rule out most
passages, many at a time: items are cut into ranges, and a passage whose terms' greatest impacts in a range
do not add up to the threshold, in any range, holds none of them. For the others, block-max WAND retrieves
all items above the threshold. Each is then verified against the text
around the passage: half of the word trigrams of its question and half of those of its answer have to stand there (of
parts of fewer than eight words: of their word pairs). An
item of one sentence has no answer to look for. So a question without its answer, however long, is no hit.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import quoted, staged, table, without

K1, B = 1.2, 0.75
BLOCK = 64
#: Items in a range, at least, and ranges of a class index, at most, for ruling out passages together.
RANGE, MAX_RANGES = 4, 64
#: Passages ruled out at a time.
TOGETHER = 512
SMALLEST_CLASS = 16
#: Share of an item's own score that a passage has to reach.
THRESHOLD = 0.4
#: Share of trigrams that has to stand there, of the question and of the answer alike.
PART_OVERLAP = 0.5
#: Words in a gram, and in one of a part of fewer than ``SHORT_PART`` words, where a single change would cost all.
GRAM, SHORT_GRAM, SHORT_PART = 3, 2, 8
#: Text of benchmark items held in one index, in bytes; larger benchmarks are searched index by index.
INDEX_BYTES = 8 << 20
HIT = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last line or sentence is its answer, what stands before it its question; an item of one
    sentence is a question only."""
    parts = [t for p in _SENTENCE_END.split(text) if (t := tokens(p))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM if len(words) >= SHORT_PART else SHORT_GRAM, len(words))
    return set(zip(*(words[k:] for k in range(n)))) if n else set()


class ClassIndex:
    """Postings of the items of one length class, in blocks with their greatest impacts."""

    def __init__(self, width: int, items: list[tuple[int, str, list[str]]], n: int, mean: float, df: dict[str, int]) -> None:
        """``n``, ``mean`` and ``df`` count all items of the class: their number, mean length and document
        frequencies, whichever of them ``items`` are."""
        self.width, self.ids = width, [i for i, _, _ in items]
        self.parts = [tuple(map(_grams, question_and_answer(text))) for _, text, _ in items]
        counts = [Counter(words) for _, _, words in items]
        self.terms: dict[str, int] = {}
        for w in (w for c in counts for w in c):
            self.terms.setdefault(w, len(self.terms))
        idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in self.terms}
        self.docs: list[list[int]] = [[] for _ in self.terms]
        self.impacts: list[list[float]] = [[] for _ in self.terms]
        for d, c in enumerate(counts):
            norm = K1 * (1 - B + B * sum(c.values()) / mean)
            own = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in c.items()}
            total = sum(own.values())
            for w, x in own.items():
                self.docs[self.terms[w]].append(d)
                self.impacts[self.terms[w]].append(x / total)
        self.block_max = [[max(p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)] for p in self.impacts]
        self.most = [max(p) for p in self.impacts]
        step = max(RANGE, -(-len(items) // MAX_RANGES))
        self.range_max = np.zeros((len(self.terms) + 1, -(-len(items) // step)), dtype=np.float32)  # its last row: no term
        for t, (own, impacts) in enumerate(zip(self.docs, self.impacts)):
            np.maximum.at(self.range_max[t], np.array(own) // step, impacts)

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items that score ``least`` or more for the distinct terms, by block-max WAND."""
        found, at = [], dict.fromkeys(terms, 0)
        live = sorted(at, key=lambda t: self.docs[t][0])
        least -= 1e-12
        while live:
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = self.docs[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.docs[live[pivot + 1]][at[live[pivot + 1]]] == doc:
                pivot += 1
            near, ends = 0.0, []
            for t in live[: pivot + 1]:
                k = self._block(t, at[t], doc)
                if k < len(self.block_max[t]):
                    near += self.block_max[t][k]
                    ends.append(self.docs[t][min(len(self.docs[t]), (k + 1) * BLOCK) - 1])
            if near >= least:
                if self.docs[live[0]][at[live[0]]] == doc:
                    on = [t for t in live[: pivot + 1] if self.docs[t][at[t]] == doc]
                    if (score := sum(self.impacts[t][at[t]] for t in on)) >= least:
                        found.append((doc, score))
                    to = doc + 1
                else:
                    to = doc
            else:  # nothing up to the nearest block end, or up to the next term's item, can reach the threshold
                to = min(ends, default=doc) + 1
                if pivot + 1 < len(live):
                    to = min(to, self.docs[live[pivot + 1]][at[live[pivot + 1]]])
                to = max(to, doc + 1)
            for t in live[: pivot + 1]:
                own = self.docs[t]
                while at[t] < len(own) and own[at[t]] < to:
                    at[t] += 1
            live = sorted((t for t in live if at[t] < len(self.docs[t])), key=lambda t: self.docs[t][at[t]])
        return found

    def _block(self, t: int, start: int, doc: int) -> int:
        k = start // BLOCK
        while k < len(self.block_max[t]) and self.docs[t][min(len(self.docs[t]), (k + 1) * BLOCK) - 1] < doc:
            k += 1
        return k

    def hits(self, words: list[str]) -> dict[int, tuple[float, float, float]]:
        """Verified items of a text: score, shares of the question's and of the answer's trigrams."""
        n, w, half = len(words), self.width, self.width // 2
        ids = np.full(-(-n // half) * half, -1, dtype=np.int32)
        ids[:n] = np.fromiter(map(self.terms.get, words, repeat(-1)), dtype=np.int32, count=n)
        halves = ids.reshape(-1, half)
        passages = np.concatenate([halves[:-1], halves[1:]], axis=1) if len(halves) > 1 else halves
        likely: list[int] = []
        for k in range(0, len(passages), TOGETHER):
            some = np.sort(passages[k : k + TOGETHER], axis=1)
            some[:, 1:][some[:, 1:] == some[:, :-1]] = -1  # a term counts once
            likely += (k + np.flatnonzero(self.range_max[some].sum(axis=1).max(axis=1) >= THRESHOLD - 1e-4)).tolist()
        best: dict[int, tuple[float, float, float]] = {}
        for p in likely:
            s, terms = p * half, [t for t in dict.fromkeys(passages[p].tolist()) if t >= 0]
            for item, score in self.search(terms, THRESHOLD):
                around = words[max(0, s - w) : s + 2 * w]
                there = [set(zip(*(around[k:] for k in range(g)))) for g in range(1, GRAM + 1)]
                share = lambda grams: len(grams & there[len(next(iter(grams))) - 1]) / len(grams) if grams else 1.0  # noqa: B023, E731
                q, a = map(share, self.parts[item])
                if q >= PART_OVERLAP and a >= PART_OVERLAP and (score, q, a) > best.get(item, (0, 0, 0)):
                    best[item] = (score, q, a)
        return best


def width_of(words: list[str]) -> int:
    """The length class of an item."""
    return max(SMALLEST_CLASS, 1 << (len(words) - 1).bit_length())


def class_counts(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(width, n, mean) of each length class, and (width, word, df) of its words, over the whole benchmark. Items
    without a word are of no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w for t in b.column("text").to_pylist() if (w := tokens(t))]
            columns = (map(width_of, words), pa.int32()), (map(len, words), pa.int64()), ((sorted(set(w)) for w in words), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], names=["width", "words", "distinct"])

    items = staged(benchmark.select("text").mapInArrow(run, "width int, words long, distinct array<string>"), "decontamination-items")
    classes = items.groupBy("width").agg(F.count("*").alias("n"), F.avg("words").alias("mean"))
    return classes, items.select("width", F.explode("distinct").alias("word")).groupBy("width", "word").agg(F.count("*").alias("df"))


def build_indexes(items: list[tuple[int, str]], classes: dict[int, tuple[int, float]], df: dict[int, dict[str, int]]) -> list[ClassIndex]:
    """One index per length class, by the counts of all items. Items without a word cannot be found and are left out."""
    of: dict[int, list] = {}
    for item, text in sorted(items, key=lambda x: (x[0] is None, x[0], x[1])):
        if words := tokens(text):
            of.setdefault(width_of(words), []).append((item, text, words))
    return [ClassIndex(width, some, *classes[width], df[width]) for width, some in sorted(of.items())]


def hits_of(text: str | None, indexes: list[ClassIndex]) -> list[dict]:
    words = tokens(text)
    found = [(ix.ids[k], *x) for ix in indexes for k, x in ix.hits(words).items()] if words else []
    return [dict(zip(("item_id", "score", "question", "answer"), x)) for x in sorted(found, key=lambda x: (x[0] is None, x[0]))]


def with_hits(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` with ``hits``: the benchmark items that each text contains, by item_id.

    Document frequencies and lengths are counted over the whole benchmark, so scores do not depend on how many
    indexes it takes.

    A null text has none. Items of equal text are each reported. Texts are read whole, equal rows get equal
    hits, an empty table stays empty and an empty benchmark gives no hits; an input column named hits is
    replaced. A benchmark of more than ``index_bytes`` is dealt by hash over several indexes, each of which
    all texts are searched in; no worker holds more than one."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = -(-size // index_bytes)
    docs = without(docs, "hits")
    names = [quoted(c) for c in docs.columns]
    if rounds == 0:
        return docs.select(*names, F.array().cast(HIT).alias("hits"))
    searchers = _searchers(benchmark, rounds)
    if rounds == 1:
        return docs.select(*names, searchers[0](F.col("text")).alias("hits"))
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "decontamination-rows")
    found = reduce(DataFrame.unionByName, [staged(rows.select("__row", F.inline(search(F.col("text")))), "decontamination-hits") for search in searchers])
    hits = found.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("item_id", "score", "question", "answer"))).alias("hits"))
    return rows.join(hits, "__row", "left").select(*names, F.coalesce("hits", F.array().cast(HIT)).alias("hits"))


def _searchers(benchmark: DataFrame, rounds: int) -> list:
    """Functions of texts, one an index. What is collected for each are its items and the counts of their words:
    its bytes are bounded, give or take the spread of the hash that deals the items."""
    classes, words = class_counts(benchmark)
    of_class = {r["width"]: (r["n"], r["mean"]) for r in classes.collect()}
    words, out = staged(words, "decontamination-words"), []
    for k in range(rounds):
        part = benchmark.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k))
        items, df = [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()], {}
        if rounds == 1:
            counts = words
        else:
            counts = words.join(class_counts(part)[1].select("width", "word"), ["width", "word"])
        for r in counts.collect():
            df.setdefault(r["width"], {})[r["word"]] = r["df"]
        # as bytes that carry their classes: executors need no copy of the package
        out.append(_search(benchmark.sparkSession.sparkContext.broadcast(cloudpickle.dumps(build_indexes(items, of_class, df)))))
    return out


def _search(held: Broadcast):  # noqa: ANN202

    @F.pandas_udf(HIT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indexes = pickle.loads(held.value)
        for texts in batches:
            yield pd.Series([hits_of(t, indexes) for t in texts], dtype=object)

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text contains no benchmark item, with all their columns."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("__doc"), "text")
    return with_hits(rows, benchmark).where(F.size("hits") == 0).select("__doc.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item found in it."""
    found = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("hits"))
