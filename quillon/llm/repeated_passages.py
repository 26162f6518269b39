"""Repeated passages, found by recompression.

A window is 20 consecutive words of a document. Words that a window covers go if the same window also starts earlier:
in a document of smaller id, or before in the same one. So the first copy of a passage stays and all others go.

Recompression shortens texts in rounds. A round names every maximal run of one symbol, then splits symbols in left and
right ones and names every pair of a left one before a right one. Names are a function of what they stand for (64 bits
of it), the same in every task and document; so equal stretches of words get equal symbols, but for a few at their
ends. What each symbol depends on is known exactly: its zone, the words that decided how it was cut. Texts with the
zone's words have the symbol.

1. After ``ROUNDS`` rounds, Spark counts every symbol over all documents. One that occurs once proves that every window
   which holds its zone occurs once. Only these symbols go back, each to its one document, so frequent ones never
   move beyond their partial counts. Windows that are left can be repeated.
2. Documents with such windows are recompressed to the end. Symbols of 32 words or more that stand for such windows
   only are long repeats in waiting: Spark groups them by a 128-bit digest of their words and takes the first place of
   each. All but the first are repeats, with every window inside, however long they are.
3. Windows that no such symbol has settled are grouped the same way: those across the ends of long repeats, and those
   of first places.

So a passage costs rows in proportion to its symbols and its ends, not to its windows, and no pair of copies is
formed. Groups of copies are never gathered: first places are aggregated map-side, and rows find theirs by a join
that adaptive execution splits where it is skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACES, staged, table

WINDOW = 20
#: Symbols of a run whose zones are looked at side by side with those of other runs.
SHORT_RUN = 4
#: Rounds of recompression before symbols are counted.
ROUNDS = 4
#: Words of a symbol that is settled as a whole, at least. Shorter ones settle few windows.
LONG = 32
#: Bytes of text in a block, about: documents are dealt to blocks by a hash, and symbols go back to blocks.
BLOCK_BYTES = 2 << 20
#: Bytes of texts recompressed together, about, and bytes whose words are named together.
TOGETHER, SEGMENT = 1 << 20, 1 << 18
PLACE = "hi long, lo long, block int, at int, doc_id long, start int, end int"
_GAP, _ONCE = np.uint64(0), 1 << 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D


class Symbols(NamedTuple):
    """A sequence of symbols: names, the words [start, end) that each stands for, names of the first and the last of
    these, and its zone [left, right), if zones are asked for."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray | None
    right: np.ndarray | None


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Bytes that are not white space, and a number for every byte.
_INSIDE = ~np.isin(np.arange(256), list(SPACES.encode()))
_SPREAD = mixed(np.arange(1, 257, dtype=np.uint64))


class Words(NamedTuple):
    """Texts as words. ``names`` has a gap before, between and after the texts; ``first`` is where each text's words begin in
    it, ``base`` the number of words before each text, ``size`` that of its own. ``joined`` holds all words with one space
    between, and word k begins there at ``cuts[k]``."""

    names: np.ndarray
    first: np.ndarray
    base: np.ndarray
    size: np.ndarray
    joined: memoryview
    cuts: np.ndarray

    def text(self, k: int) -> memoryview:
        """The words of a text with one space between."""
        a, n = int(self.base[k]), int(self.size[k])
        return self.joined[self.cuts[a] : self.cuts[a + n] - 1] if n else self.joined[:0]


def words_of(texts: pa.Array) -> Words:
    """The words of an array of strings; a null has none."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _INSIDE[data]
    begins = np.empty(len(data), dtype=bool)
    begins[1:], begins[:1] = inside[1:] & ~inside[:-1], inside[:1]
    at = ends[:-1][ends[:-1] < len(data)]
    begins[at] = inside[at]  # a word ends with its text
    start = np.flatnonzero(begins)
    of = np.searchsorted(start, ends)  # words before each text
    word = np.cumsum(begins, dtype=np.int32)[inside]  # of each byte that is no white space, from 1
    length = np.bincount(word, minlength=len(start) + 1)[1:]
    cuts = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(int(cuts[-1]), 32, dtype=np.uint8)
    joined[np.arange(len(word)) + word - 1] = data[inside]
    base, size = of[:-1], np.diff(of)
    first = 1 + base + np.arange(len(texts))
    names = np.zeros(len(start) + len(texts) + 1, dtype=np.uint64)
    at = np.ones(len(names), dtype=bool)
    at[0] = False
    at[first + size] = False
    names[at] = _named(joined, cuts)
    return Words(names, first, base, size, memoryview(joined), cuts)


def _named(joined: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A name for every word: a sum over its bytes times powers of an odd number, spread. Words of one name need not be
    equal: names only choose what is compared, and digests of the words decide."""
    out = np.empty(len(cuts) - 1, dtype=np.uint64)
    k = 0
    while k < len(out):
        upto = max(k + 1, int(np.searchsorted(cuts, cuts[k] + SEGMENT, side="right")) - 1)
        low, high = int(cuts[k]), int(cuts[upto])
        up, down = _powers(max(SEGMENT, 1 << (high - low - 1).bit_length()))
        total = np.empty(high - low + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_SPREAD[joined[low:high]] * up[: high - low], out=total[1:])
        begin = cuts[k:upto] - low
        out[k:upto] = mixed((total[cuts[k + 1 : upto + 1] - 1 - low] - total[begin]) * down[begin])
        k = upto
    out[out == _GAP] = 1
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    out = np.empty((2, n), dtype=np.uint64)
    out[:, 0], out[0, 1:], out[1, 1:] = 1, _BASE, pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(out, axis=1))


def spelled(words: np.ndarray, zones: bool = True) -> Symbols:
    """Each word as a symbol."""
    at = np.arange(len(words) + 1, dtype=np.int32 if len(words) < 1 << 31 else np.int64)
    return Symbols(words, at[:-1], at[1:], words, words, *((at[:-1], at[1:]) if zones else (None, None)))


def compressed(s: Symbols, round_: int) -> Symbols:
    """One round: runs, then pairs. Gaps stay, and nothing is formed across them."""
    return _pairs(_runs(s), round_)


def _runs(s: Symbols) -> Symbols:
    head = np.ones(len(s.name), dtype=bool)
    head[1:] = (s.name[1:] != s.name[:-1]) | (s.name[1:] == _GAP)
    at = np.flatnonzero(head)
    alone = len(at) == len(head)
    if alone and s.left is None:
        return s
    times = np.diff(at, append=len(head))
    many = np.flatnonzero(times > 1)
    name, end = s.name[at], s.end[at]
    name[many] = mixed(name[many] + times[many].astype(np.uint64) * _ODD)
    name[many[name[many] == _GAP]] = 1
    end[many] = s.end[at[many] + times[many] - 1]
    first, last = s.first[at], s.last[at]
    if s.left is None:
        return Symbols(name, s.start[at], end, first, last, None, None)
    left, right = s.left[at], s.right[at]
    for x, of, least in ((left, s.left, np.minimum), (right, s.right, np.maximum)):
        for k in range(1, int(times.max(initial=1))):
            more = many[times[many] > k]
            x[more] = least(x[more], of[at[more] + k])
            if k >= SHORT_RUN:  # the rest of long runs at once, run by run
                for i in more[times[more] > k + 1].tolist():
                    x[i] = least(x[i], least.reduce(of[at[i] + k : at[i] + times[i]]))
                break
    # a run ends where another symbol follows: one whose next word differs, or else the whole of that symbol
    np.maximum(right[:-1], end[:-1] + 1, out=right[:-1])
    np.minimum(left[1:], s.start[at[1:]] - 1, out=left[1:])
    like = np.flatnonzero(first[1:] == first[:-1])
    after = at[like + 1]
    right[like], left[like] = np.maximum(right[like], s.right[after]), np.minimum(left[like], s.left[after])
    like = np.flatnonzero(last[1:] == last[:-1]) + 1
    before = at[like] - 1
    right[like], left[like] = np.maximum(right[like], s.right[before]), np.minimum(left[like], s.left[before])
    return Symbols(name, s.start[at], end, first, last, left, right)


def _pairs(s: Symbols, round_: int) -> Symbols:
    # names are spread: each of their bits is a fair side, and after 64 rounds those of other names
    sides = s.name if round_ < 64 else mixed(s.name + np.uint64(round_ // 64) * _ODD)
    side, word = (sides >> np.uint64(round_ % 64)) & np.uint64(1) == 0, s.name != _GAP
    ahead, behind = side & word, ~side & word
    pair = ahead[:-1] & behind[1:]
    one = np.flatnonzero(pair)
    kept = np.ones(len(s.name), dtype=bool)
    kept[one + 1] = False
    name, end, last = s.name.copy(), s.end.copy(), s.last.copy()
    name[one] = mixed(mixed(s.name[one]) + s.name[one + 1])
    name[one[name[one] == _GAP]] = 1
    end[one], last[one] = s.end[one + 1], s.last[one + 1]
    if s.left is None:
        return Symbols(name[kept], s.start[kept], end[kept], s.first[kept], last[kept], None, None)
    left, right = s.left.copy(), s.right.copy()
    # what a pair is decided by, and why a symbol stays alone: the next is no right one, or the one before no left one
    ahead[one] = behind[one + 1] = False
    for of, by in ((one, 1), (np.flatnonzero(ahead), 1), (np.flatnonzero(behind), -1)):
        left[of], right[of] = np.minimum(s.left[of], s.left[of + by]), np.maximum(s.right[of], s.right[of + by])
    return Symbols(name[kept], s.start[kept], end[kept], s.first[kept], last[kept], left[kept], right[kept])


def low_symbols(words: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    s = spelled(words)
    for k in range(rounds):
        s = compressed(s, k)
    return s


# ---- symbols that occur once


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Texts as words, up to ``TOGETHER`` bytes of them together: (first, last, words)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    upto, first = np.cumsum(size, dtype=np.int64), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + TOGETHER, side="right")))
        yield first, last, words_of(texts.slice(first, last - first))
        first = last


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of texts, each once for texts named together: 2^32 and the block of its text, or twice that if it
    occurs several times. So a sum under 2^33 over all tasks means that it occurs once, and where."""
    for b in batches:
        blocks = b.column(0).to_numpy().astype(np.int64)
        for first, last, words in _chunks(b.column(1)):
            s = low_symbols(words.names)
            name, at, times = np.unique(s.name, return_index=True, return_counts=True)
            of = np.searchsorted(words.first, s.start[at], side="right") - 1
            told = np.where(times == 1, _ONCE + blocks[first:last][np.maximum(of, 0)], 2 * _ONCE)[name != _GAP]
            yield pa.RecordBatch.from_arrays([pa.array(name[name != _GAP].view(np.int64)), pa.array(told)], names=["name", "told"])


def _candidates(texts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The documents of a block: those with windows that can be repeated keep their text and these windows (as
    ranges of starts), of the others there is the result."""

    def run(docs: pa.Table, once: pa.Table) -> pa.Table:
        unique = np.sort(once.column("name").to_numpy().view(np.uint64))
        own = docs.column("text").combine_chunks()
        live, counts, kept = [], [], []
        for _, _, words in _chunks(own):
            s = low_symbols(words.names)
            k = np.flatnonzero((s.right - s.left <= WINDOW) & _among(s.name, unique))
            dead = np.zeros(len(words.names) + 1, dtype=np.int32)
            np.add.at(dead, np.maximum(s.right[k] - WINDOW, 0), 1)
            np.add.at(dead, s.left[k] + 1, -1)
            alive = np.cumsum(dead) == 0
            for t, (at, n) in enumerate(zip(words.first.tolist(), words.size.tolist())):
                flags = alive[at : at + max(0, n - WINDOW + 1)]
                live.append(_ranges(flags) if flags.any() else [])
                counts.append(n)
                kept.append(None if len(live[-1]) else _kept(words.text(t), texts))
        held = pc.if_else(pc.is_null(pa.array(kept, pa.string())), own, pa.scalar(None, own.type))
        return pa.table({
            "block": docs.column("block"), "at": pa.array(range(len(own)), pa.int32()), "doc_id": docs.column("doc_id"), "text": held,
            "live": pa.array(live, pa.list_(pa.int32())), "n_words": pa.array(counts, pa.int64()), "kept": pa.array(kept, pa.string()),
        })

    return run


def _among(names: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which names are among some, which are sorted."""
    if not len(some):
        return np.zeros(len(names), dtype=bool)
    return some[np.minimum(np.searchsorted(some, names), len(some) - 1)] == names


def _kept(joined: memoryview | bytes, texts: bool) -> str:
    return bytes(joined).decode("utf-8") if texts else sha256(joined).hexdigest()


def _ranges(flags: np.ndarray) -> np.ndarray:
    """Where flags are set, as starts and ends in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).astype(np.int32)


def _flags(ranges: list[int] | np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` flags of ranges."""
    turn = np.zeros(n + 1, dtype=np.int8)
    at = np.array(ranges, dtype=np.int64)
    np.add.at(turn, at[0::2], 1)
    np.add.at(turn, at[1::2], -1)
    return np.cumsum(turn[:-1]) > 0


# ---- long repeats


def _digests(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of stretches of words (numbers of words), as two signed numbers each."""
    joined, digest = words.joined, xxhash.xxh3_128_digest
    spans = zip(words.cuts[start].tolist(), (words.cuts[end] - 1).tolist())
    return np.frombuffer(b"".join([digest(joined[a:b]) for a, b in spans]), dtype="<i8").reshape(-1, 2)


def long_symbols(words: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the symbols of ``LONG`` words or more, of all rounds, all of whose windows are alive."""
    upto = np.concatenate([[0], np.cumsum(alive)])
    s, round_, seen = spelled(words, zones=False), 0, np.ones(len(words), dtype=np.int32)
    starts, ends = [], []
    while True:
        s = compressed(s, round_)
        round_ += 1
        k = np.flatnonzero((s.end - s.start >= LONG) & (s.end - s.start > seen[s.start]))
        a, b = s.start[k], s.end[k]
        seen[a] = b - a
        k = upto[b - WINDOW + 1] - upto[a] == b - WINDOW + 1 - a
        starts.append(a[k])
        ends.append(b[k])
        gap = s.name == _GAP
        if (gap[1:] | gap[:-1]).all():  # each text is one symbol
            return np.concatenate(starts), np.concatenate(ends)


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of long symbols."""
    for b in batches:
        block, at, doc_id = (b.column(k) for k in range(3))
        live = b.column(4)
        for first, last, words in _chunks(b.column(3)):
            alive = np.zeros(len(words.names), dtype=bool)
            for a, n, ranges in zip(words.first.tolist(), words.size.tolist(), live.slice(first, last - first).to_pylist()):
                alive[a : a + n] = _flags(ranges, n)
            low, high = long_symbols(words.names, alive)
            of = np.searchsorted(words.first, low, side="right") - 1
            low, high = low - words.first[of], high - words.first[of]
            digests, row = _digests(words, words.base[of] + low, words.base[of] + high), pa.array(first + of)
            columns = [pa.array(digests[:, 0]), pa.array(digests[:, 1]), block.take(row), at.take(row), doc_id.take(row), pa.array(low, pa.int32()), pa.array(high, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "block", "at", "doc_id", "start", "end"])


def later_places(places: DataFrame) -> DataFrame:
    """(block, at, start, end) of the places whose digest has a place before."""
    first = places.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = places.join(first, ["hi", "lo"]).where(~F.col("first").eqNullSafe(F.struct("doc_id", "start")))
    return later.select("block", "at", "start", "end")


# ---- single windows


def _by_id(docs: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents in order of id, nulls first, and the rank of each id."""
    docs = docs.sort_by([("doc_id", "ascending")])
    ids = docs.column("doc_id").combine_chunks()
    nulls = ids.null_count  # sorted to the end
    docs = pa.concat_tables([docs.slice(len(docs) - nulls), docs.slice(0, len(docs) - nulls)])
    known = ids.slice(0, len(ids) - nulls).to_numpy()
    step = np.concatenate([np.zeros(nulls, dtype=np.int64), np.ones(len(known), dtype=np.int64)])
    step[nulls + 1 :] = known[1:] != known[:-1]
    return docs, np.cumsum(step)


def _open_windows(docs: pa.Table, settled: pa.Table) -> pa.Table:
    """What a block has to say of the windows that no long repeat has settled: for each digest the first place here,
    and the places after it, which are repeats for certain. ``row`` holds block and document, ``place`` the window's start and
    whether it is a later one: rows are many, and travel in five numbers."""
    docs, rank = _by_id(docs)
    words = words_of(docs.column("text").combine_chunks())
    base, n = words.base, len(words.cuts) - 1
    live = docs.column("live").combine_chunks()
    # differences of flags over the words of all documents
    turn, inside = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32)
    ranges = live.flatten().to_numpy() + np.repeat(base, np.diff(live.offsets.to_numpy()))
    np.add.at(turn, ranges[0::2], 1)
    np.add.at(turn, ranges[1::2], -1)
    numbers = docs.column("at").to_numpy()
    of = {at: k for k, at in enumerate(numbers.tolist())}
    place = base[np.fromiter(map(of.__getitem__, settled.column("at").to_pylist()), dtype=np.int64, count=len(settled))]
    np.add.at(inside, place + settled.column("start").to_numpy(), 1)
    np.add.at(inside, place + settled.column("end").to_numpy() - WINDOW + 1, -1)
    at = np.flatnonzero((np.cumsum(turn[:-1]) > 0) & (np.cumsum(inside[:-1]) == 0))
    digest = _digests(words, at, at + WINDOW)
    doc = np.searchsorted(base + words.size, at, side="right")
    start = at - base[doc]
    # windows come in order of id and start already
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (digest[order][1:] != digest[order][:-1]).any(axis=1)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = ~new & ((rank[doc[order]] != rank[doc[head]]) | (start[order] != start[head]))
    # equal rows of one id: none is later, each says that it is there
    k = np.concatenate([order[~later], order[later]])
    again = np.arange(len(k)) >= len(k) - later.sum()
    blocks = docs.column("block").to_numpy().astype(np.int64)
    # the later ones are asked about no more: they get numbers of their own instead of a digest that many share
    return pa.table({
        "hi": np.where(again, k, digest[k, 0]), "lo": np.where(again, start[k], digest[k, 1]), "doc_id": docs.column("doc_id").take(pa.array(doc[k])),
        "row": blocks[doc[k]] << 32 | numbers[doc[k]], "place": start[k] << 1 | again,
    })


def _without_repeats(texts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The results of a block's documents, from the stretches of words that are repeats."""

    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        gone = gone.sort_by("at")
        numbers, start, end = (gone.column(c).to_numpy() for c in ("at", "start", "end"))
        at = docs.column("at").to_numpy()
        low, high = np.searchsorted(numbers, at, side="left").tolist(), np.searchsorted(numbers, at, side="right").tolist()
        counts, removed, spans, kept = [], [], [], []
        words = words_of(docs.column("text").combine_chunks())
        for k, (i, j, first, n) in enumerate(zip(low, high, words.base.tolist(), words.size.tolist())):
            ranges = _ranges(_flags(np.column_stack([start[i:j], end[i:j]]).ravel(), n)) if i < j else []
            cuts = [0, *(int(x) for x in ranges), n]
            stay = [(a, b) for a, b in zip(cuts[0::2], cuts[1::2]) if a < b]
            parts = [words.joined[words.cuts[first + a] : words.cuts[first + b] - 1] for a, b in stay]
            counts.append(n)
            removed.append(n - sum(b - a for a, b in stay))
            spans.append(ranges)
            kept.append(_kept(b" ".join(parts), texts))
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.int32())), "kept": pa.array(kept, pa.string()),
        })

    return run


def repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, ``n_words``, ``n_removed``, ``removed`` (starts and ends, in turn,
    of the stretches of words that go) and ``kept``: the words that stay, joined by one space, or, without ``texts``,
    the SHA-256 of that.

    Windows are judged on the input. A null text has no words; a text under 20 words keeps all. Null ids come before
    all others. Rows of equal id are one document at equal places: the window that starts earlier stays, and of equal
    rows all windows do. Texts are read whole, the memory of a task grows with its longest text; an empty table gives
    an empty one; other columns are ignored."""
    n_blocks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.select("block", "text").mapInArrow(_counted, "name long, told long")
    # one number for each symbol that a task has seen; what goes on is bound for one block each
    once = counted.groupBy("name").agg(F.sum("told").alias("told")).where(F.col("told") < 2 * _ONCE)
    once = once.select((F.col("told") - _ONCE).cast("int").alias("block"), "name")
    schema = "block int, at int, doc_id long, text string, live array<int>, n_words long, kept string"
    judged = staged(rows.groupBy("block").cogroup(once.groupBy("block")).applyInArrow(_candidates(texts), schema), "passages-judged")
    settled = judged.where("kept IS NOT NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<int>").alias("removed"), "kept")
    held = judged.where("kept IS NULL").select("block", "at", "doc_id", "text", "live")
    places = staged(held.mapInArrow(_long, PLACE), "passages-long")
    later = staged(later_places(places), "passages-later")
    # one row for each window and block, and one for each window that is a repeat within its block
    windows = held.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(_open_windows, "hi long, lo long, doc_id long, row long, place long")
    least = F.min(F.struct("doc_id", "place")).over(Window.partitionBy("hi", "lo"))
    repeated = windows.withColumn("first", least).where(~F.col("first").eqNullSafe(F.struct("doc_id", "place")) | (F.col("place").bitwiseAND(1) == 1))
    block, at, start = F.shiftright("row", 32), F.col("row").bitwiseAND(0xFFFFFFFF), F.shiftright("place", 1)
    gone = later.unionByName(repeated.select(*[x.cast("int").alias(c) for c, x in (("block", block), ("at", at), ("start", start), ("end", start + WINDOW))]))
    schema = "doc_id long, n_words long, n_removed long, removed array<int>, kept string"
    return settled.unionByName(held.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_without_repeats(texts), schema))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(len(words) - 19)) AS start FROM d WHERE len(words) >= 20),
w AS (SELECT doc_id, start, array_to_string(words[start + 1 : start + 20], ' ') AS own FROM p),
f AS (SELECT doc_id, start, min(struct_pack(d := doc_id, s := start)) OVER (PARTITION BY own) AS first FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS k FROM f WHERE first <> struct_pack(d := doc_id, s := start)),
r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id),
e AS (SELECT d.doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda w, k: NOT list_contains(gone, k - 1)), ' ')) AS kept_sha256 FROM e
"""
