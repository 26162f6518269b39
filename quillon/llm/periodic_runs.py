"""Runs of repeated words, found by Karp-Miller-Rosenberg names.

A run is a stretch of words with a smallest period q, at least three periods and 24 words long, that no neighbouring
word extends. Texts are laid side by side, a name of its own between any two, and named together: level 0 names
words, and level k names stretches of 2^k words by the pair of names of their halves, ranked by sorting. So equal names
mean equal stretches, exactly. How far two places agree (their longest common extension) takes one step a level, from
the highest down, for all pairs of places at once.

Words that repeat with period q agree with the words q later over max(24 - q, 2q) places at least. Of every that
many places one is on the period's grid, so each run of the period holds a grid place that agrees with the place q
later; from there it is extended in both directions. Grids of all periods take n log n places.

Texts lie in order of length, the longest first: a level or a period that short texts are too short for only reads
the beginning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.llm.common import quoted, table, without

MIN_WORDS, MIN_PERIODS = 24, 3
#: Texts are named together up to so many words; a longer one is named by itself.
TOGETHER = 1 << 17
#: Grid places looked at together.
PLACES = 1 << 20
#: Rows of the registered query whose ends are made periodic: those whose id's checksum this divides.
PLANTED = 10
RESULT = StructType([
    *[StructField(c, LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")],
    *[StructField(c, StringType()) for c in ("runs_sha256", "collapsed_sha256")],
])


class Runs(NamedTuple):
    """Runs of several texts, by text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    rank = np.empty(len(keys), dtype=np.int32)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]), dtype=np.int32)
    return rank


def ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a on equal those from b on (a < b)."""
    a, b, got = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        same = np.flatnonzero(b < len(name))
        same = same[name[a[same]] == name[b[same]]]
        for x in (a, b, got):
            x[same] += 1 << k
    return got


def behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before a equal those before b (a < b)."""
    a, b, got = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, step = levels[k], 1 << k
        same = np.flatnonzero((a >= step) & (b - step < len(name)))
        same = same[name[a[same] - step] == name[b[same] - step]]
        for x, by in ((a, -step), (b, -step), (got, step)):
            x[same] += by
    return got


def _grid(reach: np.ndarray, spacing: np.ndarray, periods: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places of each period, up to its reach, and the period of each: about ``PLACES`` at a time."""
    counts = -(-reach // spacing)
    upto = np.cumsum(counts)
    first = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PLACES, side="right")))
        n = counts[first:last]
        of = np.repeat(np.arange(first, last), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        yield k * spacing[of], periods[of]
        first = last


def find_runs(texts: list[np.ndarray]) -> Runs:
    """All runs of several texts, given as words' names (numbers from 0; equal words have equal names in all texts)."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    size = np.array([len(texts[i]) for i in order], dtype=np.int64)
    starts = np.cumsum(size + 1) - size - 1
    n, longest = int((size + 1).sum()), int(size[0]) if len(size) else 0
    if longest < MIN_WORDS:
        return Runs(*[np.empty(0, dtype=np.int64)] * 4)
    words = np.empty(n, dtype=np.int32)
    beyond = 1 + max(int(t.max()) for t in texts if len(t))
    for k, i in enumerate(order):
        words[starts[k] : starts[k] + size[k]] = texts[i]
        words[starts[k] + size[k]] = beyond + k
    levels = [words]
    while (half := 1 << (len(levels) - 1)) * 2 <= longest:
        # names of stretches that lie in texts long enough: these are the first ones
        end = int((size[size >= 2 * half] + 1).sum())
        below = levels[-1][:end]
        levels.append(_ranks(below[: len(below) - half].astype(np.int64) << 32 | below[half:]))
    periods = np.arange(1, longest // MIN_PERIODS + 1, dtype=np.int64)
    spacing = np.maximum(MIN_WORDS - periods, (MIN_PERIODS - 1) * periods)
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    # words of the texts that are long enough for the period, which come first
    reach = ends[np.searchsorted(-size, -np.maximum(MIN_WORDS, MIN_PERIODS * periods), side="right")] - periods
    found = [np.empty((0, 3), dtype=np.int64)]
    for at, q in _grid(np.maximum(reach, 0), spacing, periods):
        same = words[at] == words[at + q]
        at, q = at[same], q[same]
        least = np.maximum(MIN_WORDS, MIN_PERIODS * q) - q
        right = ahead(levels, at, at + q)
        left = behind(levels, at, at + q)
        long = left + right >= least
        found.append(np.column_stack([at - left, left + right + q, q])[long])
    # a stretch found by several grid places, or by multiples of its period, counts once, by the smallest
    all_ = np.concatenate(found)
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
    new = np.ones(len(all_), dtype=bool)
    new[1:] = (all_[1:, :2] != all_[:-1, :2]).any(axis=1)
    start, length, period = all_[new].T
    k = np.searchsorted(starts, start, side="right") - 1
    text, start = order[k], start - starts[k]
    by = np.lexsort((period, start, text))
    return Runs(text[by], start[by], length[by], period[by])


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run of greatest exact length / period; of several the first by start, then by period."""
    share = length / period
    best = -1
    for k in np.flatnonzero(share >= share.max() * (1 - 1e-9)).tolist():
        if best < 0 or int(length[k]) * int(period[best]) > int(length[best]) * int(period[k]):
            best = k
    return best


def collapsed(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) == 0


def planted(words: np.ndarray, doc_id: int | None, every: int) -> np.ndarray:
    """The words with a periodic end where the checksum of the id says so; a null id says nothing."""
    if doc_id is None or not len(words) or (h := zlib.crc32(str(doc_id).encode())) % every:
        return words
    n, g = len(words), h // every
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[np.concatenate([np.arange(a), a + np.arange(n - a) % p])]


def described(texts: list[list[bytes]], named: list[np.ndarray], words: list[bytes]) -> list[tuple]:
    """What ``RESULT`` holds of each text; ``named`` are its words as numbers, positions in ``words``."""
    runs, out = find_runs(named), []
    cuts = np.searchsorted(runs.text, np.arange(len(named) + 1))
    for k, own in enumerate(named):
        _, start, length, period = (x[cuts[k] : cuts[k + 1]] for x in runs)
        if not len(start):
            kept = texts[k] if texts[k] is not None else [words[w] for w in own.tolist()]
            out.append((0, None, None, None, None, sha256(b"").hexdigest(), sha256(b" ".join(kept)).hexdigest()))
            continue
        best = strongest(start, length, period)
        s, m, q = int(start[best]), int(length[best]), int(period[best])
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist()))
        kept = [words[w] for w in own[collapsed(len(own), start, length, period)].tolist()]
        out.append((len(start), s, m, q, 1000 * m // q, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()))
    return out


def _rows(texts: list[str | None], ids: list[int | None], plant: int | None) -> Iterator[list[tuple]]:
    """The results of texts in order, named together up to ``TOGETHER`` words."""
    of: dict[bytes, int] = {}
    some, named, n = [], [], 0

    def done() -> list[tuple]:
        return described(some, named, list(of))

    for text, doc_id in zip(texts, ids):
        words = (text or "").encode("utf-8").split()  # of bytes: at the six ASCII white-space bytes
        if n and n + len(words) > TOGETHER:
            yield done()
            of, some, named, n = {}, [], [], 0
        own = np.fromiter((of.setdefault(w, len(of)) for w in words), dtype=np.int32, count=len(words))
        changed = planted(own, doc_id, plant) if plant else own
        some.append(words if changed is own else None)
        named.append(changed)
        n += len(words)
    if some:
        yield done()


def with_runs(docs: DataFrame, plant: int | None = None) -> DataFrame:
    """``docs`` without ``text``, with the number of its runs; start (a word, from 0), length, period and exponent in
    thousandths of the run of greatest exponent; and digests of all runs and of the words that are left when every
    run is collapsed to its first period.

    A null text has no words; a text without runs has null numbers and the digest of nothing for its runs. Runs
    of equal exponent go by start, then by period. Equal rows get equal results, an empty table stays empty, input
    columns of the added names are replaced. Texts are named whole, the memory of a task grows with its longest text.

    With ``plant``, words are taken from the text with a periodic end in rows whose id's checksum it divides."""
    docs = without(docs, *RESULT.names)
    keep = [c for c in docs.columns if c != "text"]
    at_id = keep.index("doc_id") if "doc_id" in keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            ids = b.column(at_id).to_pylist() if at_id is not None else [None] * len(texts)
            rows = [r for part in _rows(texts, ids, plant) for r in part]
            added = [pa.array(list(c), pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int64() if k < 5 else pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *added], names=[*moved, *RESULT.names])

    moved = [f"c{k}" for k in range(len(keep))]  # mapInArrow takes no names with dots
    rows = docs.select(*[quoted(c).alias(m) for c, m in zip(keep, moved)], "text")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *RESULT.fields])).toDF(*keep, *RESULT.names)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=PLANTED)
