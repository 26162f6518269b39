"""Retrieval by an inverted index, for many questions over large corpora.

A query's words hold no white space, so a word that occurs in a text occurs in one of its tokens. The index has posting
lists (the chunks of each token, in blocks), the longest chunks of each block, and the trigrams of the vocabulary.

``ranked`` answers all questions of a corpus block by block. First it scores some of the longest chunks for every question: the
score that k of them reach is the least that any of the first k chunks can have. A task then gets a block's lists and a part of
the questions, looks up which of the tokens hold which words (by hashes of their pieces, compared byte by byte), and looks only
at the chunks that can reach a question's least score: a chunk that holds s of m words holds one of any m - s + 1, so the lists of
the rarest of them have it. What a task holds is bounded by the chunks of a block and the questions of a part, and no pair of
a question and a chunk is ever a row, but those that reach the least score.

``occurrences`` and ``candidates`` are for single words: a word is looked up by its rarest trigram, and the tokens that come up
are compared with it exactly. Scores count words, so a chunk of score s holds one of any m - s + 1 of a query's m words. A
first look at one rare word's chunks gives each question a score that k chunks reach; with it, the lists of its most
frequent words need not be read at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import BLANKS, query_words

GRAM = 3
#: A block of a posting list holds the chunks of so many neighbouring places (as a power of two) at most.
BLOCK_BITS = 14
#: A task scores about so many questions at once at most.
PART = 1 << 17
#: Questions of a part get their least scores in so many slices.
SLICES = 8
#: Questions travel in bundles of so many.
BUNDLE = 2048
#: Least scores are those of the longest chunks of some blocks: so many of each, and so many blocks, or fewer than twice as many.
LONGEST = 32
PILOTS = 8
#: Words of more bytes are looked up by their first ones, and then compared.
HEAD = 64
#: Tokens are hashed by about so many bytes at a time, so that they stay in the cache.
SLICE_BYTES = 1 << 17
#: A word with more places than this (of its tokens, added up) has a row of bits besides its list, up to so many words.
FREQUENT = 64
ROWS = 1 << 15
ROWS_AT_ONCE = 128
#: So many pairs of a question and a chunk are looked at at once, about.
PAIRS = 1 << 20


class Index(NamedTuple):
    """``postings`` (corpus_id, token, block, ords: array of bigint), ``grams`` (gram, token), ``blocks`` (corpus_id, block) and
    ``texts`` (corpus_id, block, ord, text), of which the longest of each block are read."""

    postings: DataFrame
    grams: DataFrame
    blocks: DataFrame
    texts: DataFrame


def trigrams(word: Column) -> Column:
    """Distinct runs of three characters of a word of three or more."""
    chars = F.split(word, "")
    at = lambda i: F.get(chars, i)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(chars) - GRAM), lambda i: F.concat(at(i), at(i + 1), at(i + 2))))


def tokens_of(text: Column) -> Column:
    """Distinct lower-cased tokens; those of less than three characters hold no query word and are left out."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS)), lambda t: F.char_length(t) >= GRAM)


def joined(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def starts_of(lists: pa.Array) -> np.ndarray:
    """Where each of some lists begins among all values, and the end."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _inverted(chunks: pa.Table) -> pa.Table:
    """The posting lists of a block's chunks (corpus_id, block, ord, tokens, with blanks between)."""
    lists = [pc.split_pattern(c, " ") for c in chunks["tokens"].chunks]
    sizes = np.concatenate([np.array([], np.int32), *[c.value_lengths().to_numpy(zero_copy_only=False) for c in lists]])
    tokens = pa.chunked_array([c.flatten() for c in lists], pa.string()).dictionary_encode()
    del lists
    held = tokens.chunk(0).dictionary if tokens.num_chunks else pa.array([], pa.string())
    base = chunks["block"][0].as_py() << BLOCK_BITS
    keys = np.repeat(chunks["ord"].to_numpy() - base, sizes)
    done = 0
    for c in tokens.chunks:
        keys[done : done + len(c)] |= c.indices.to_numpy(zero_copy_only=False).astype(np.int64) << BLOCK_BITS
        done += len(c)
    del tokens
    pa.default_memory_pool().release_unused()
    keys.sort()
    cuts = np.searchsorted(keys, np.arange(len(held) + 1) << BLOCK_BITS).astype(np.int32)
    keys &= (1 << BLOCK_BITS) - 1
    keys += base
    lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys))
    same = lambda name: pa.repeat(chunks[name][0], len(held))
    out = pa.table({"corpus_id": same("corpus_id"), "token": held, "block": same("block"), "ords": lists})
    # of chunks without tokens
    return out.filter(pc.not_equal(held, "")) if pc.any(pc.equal(held, "")).as_py() else out


def build(chunks: DataFrame) -> Index:
    """The index of ``chunks`` (corpus_id, ord, text). ``ord`` tells the chunks of a corpus apart. A null text has no
    tokens; tokens of less than three characters hold no query word and are left out."""
    chunks = chunks.select("corpus_id", F.shiftright(F.col("ord").cast("long"), BLOCK_BITS).alias("block"), F.col("ord").cast("long").alias("ord"), "text").where("ord IS NOT NULL")
    tokens = chunks.select("corpus_id", "block", "ord", tokens_of(F.col("text")).alias("tokens"))
    # a block's places are bounded, whatever the token
    kind = chunks.schema["corpus_id"].dataType.simpleString()
    one = tokens.withColumn("tokens", F.array_join("tokens", " "))
    postings = one.groupBy("corpus_id", "block").applyInArrow(_inverted, f"corpus_id {kind}, token string, block long, ords array<long>")
    grams = tokens.select(F.explode("tokens").alias("token")).distinct().select(F.explode(trigrams(F.col("token"))).alias("gram"), "token")
    return Index(postings, grams, chunks.select("corpus_id", "block").distinct(), chunks)


def longest(texts: DataFrame) -> DataFrame:
    """The longest chunks of each block."""
    place = F.row_number().over(Window.partitionBy("corpus_id", "block").orderBy(F.desc(F.coalesce(F.octet_length("text"), F.lit(0))), "ord"))
    return texts.withColumn("place", place).where(F.col("place") <= LONGEST).drop("place")


def write(index: Index, path: str) -> None:
    """Writes the tables, sorted by what they are looked up by: readers skip the row groups of other words."""
    index.postings.repartitionByRange("token", "corpus_id", "block").sortWithinPartitions("token", "corpus_id", "block").write.parquet(f"{path}/postings")
    index.grams.repartitionByRange("gram", "token").sortWithinPartitions("gram", "token").write.parquet(f"{path}/grams")
    longest(index.texts).write.parquet(f"{path}/texts")


def read(spark: SparkSession, path: str) -> Index:
    postings = spark.read.parquet(f"{path}/postings")
    return Index(postings, spark.read.parquet(f"{path}/grams"), postings.select("corpus_id", "block").distinct(), spark.read.parquet(f"{path}/texts"))


def tokens_with(words: DataFrame, grams: DataFrame) -> DataFrame:
    """(word, token) for all tokens of the vocabulary that hold a word, from distinct ``words`` (word)."""
    of = words.select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    count = grams.join(of.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no token has settles its word as well
    rare = of.join(count, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare"))
    return rare.select("word", "rare.gram").join(grams, "gram").where(F.contains("token", F.col("word"))).select("word", "token")


def occurrences(asked: DataFrame, index: Index) -> DataFrame:
    """(corpus_id, word, ord): which chunks hold each word that is asked of a corpus (``asked``: corpus_id, word)."""
    needed = asked.select("corpus_id", "word").distinct()
    held = needed.join(tokens_with(needed.select("word").distinct(), index.grams), "word")
    return held.join(index.postings, ["corpus_id", "token"]).select("corpus_id", "word", F.explode("ords").alias("ord")).distinct()


def candidates(asked: DataFrame, places: DataFrame, default_k: int) -> tuple[DataFrame, DataFrame]:
    """(question_id, corpus_id, words, ord) of the chunks that can be among a question's first k, and (corpus_id, ord,
    held) for scoring. ``asked``: question_id, corpus_id, top_k, word; ``places`` as of ``occurrences``."""
    frequency = places.groupBy("corpus_id", "word").agg(F.count("*").alias("df"))
    of = asked.join(frequency, ["corpus_id", "word"]).groupBy("question_id", "corpus_id").agg(
        F.first("top_k").alias("top_k"), F.sort_array(F.collect_list(F.struct("df", "word"))).alias("by_df")
    )
    k = F.coalesce("top_k", F.lit(default_k))
    enough = F.get(F.filter("by_df", lambda w: w["df"] >= k), F.lit(0))["word"]
    of = of.withColumns({"words": F.transform("by_df", lambda w: w["word"]), "word": F.coalesce(enough, F.element_at("by_df", -1)["word"]), "k": k}).drop("by_df", "top_k")
    held = places.groupBy("corpus_id", "ord").agg(F.collect_set("word").alias("held"))
    first = of.join(places, ["corpus_id", "word"]).join(held, ["corpus_id", "ord"]).withColumn("score", score())
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score")))
    # the score that k chunks reach, at least
    reached = first.withColumn("place", place).where("place = k").select("question_id", F.col("score").alias("least"))
    least = of.join(reached, "question_id", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    needed = F.slice("words", F.lit(1), F.greatest(F.size("words") - F.col("least") + 1, F.lit(1)))
    lists = least.select("question_id", "corpus_id", F.explode(needed).alias("word"))
    found = lists.join(places, ["corpus_id", "word"]).select("question_id", "corpus_id", "ord").distinct()
    return found.join(of.select("question_id", "words"), "question_id"), held


def score() -> Column:
    return F.size(F.array_intersect("words", "held"))


def raw(values: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some values, one after the other, and where each begins, and the end."""
    of = values if isinstance(values, pa.Array) else pa.array(values, pa.binary())
    if not len(of):
        return np.array([], np.uint8), np.zeros(1, np.int64)
    cuts = np.frombuffer(of.buffers()[1], np.int32)[of.offset : of.offset + len(of) + 1].astype(np.int64)
    data = np.frombuffer(of.buffers()[2], np.uint8) if of.buffers()[2] is not None else np.array([], np.uint8)
    return data[cuts[0] : cuts[-1]], cuts - cuts[0]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of some ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def once(sorted_: np.ndarray) -> np.ndarray:
    """Which of some sorted numbers differ from the one before."""
    return np.concatenate([np.ones(min(len(sorted_), 1), bool), sorted_[1:] != sorted_[:-1]])


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Heads(NamedTuple):
    """Words of one length (or the first bytes of longer ones) by their hashes: sorted, with the first place of each of the
    hashes' leading bits."""

    hashes: np.ndarray
    ids: np.ndarray
    heads: np.ndarray
    first: np.ndarray
    any: np.ndarray
    shift: np.uint64


def _heads(ids: np.ndarray, heads: np.ndarray) -> _Heads:
    hashes = np.zeros(len(ids), np.uint64)
    for j in range(heads.shape[1]):
        hashes = hashes * _STEP + heads[:, j]
    hashes *= _MIX
    order = np.argsort(hashes, kind="stable")
    bits = min(max(int(len(ids)).bit_length() + 4, 10), 20)
    shift = np.uint64(64 - bits)
    first = np.searchsorted(hashes[order] >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
    return _Heads(hashes[order], ids[order], heads[order], first, first[1:] > first[:-1], shift)


def holders(words: pa.Array | list[bytes], tokens: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of a word, place of a token that holds it), in order of both. All pieces of a token that are as long as
    some word are looked up by their hashes, and compared."""
    (letters, cuts), (data, at) = raw(words), raw(tokens)
    sizes = np.minimum(np.diff(cuts), HEAD)
    by_size = {int(m): np.flatnonzero(sizes == m) for m in np.unique(sizes) if m}
    tables = {m: _heads(ids, letters[cuts[ids][:, None] + np.arange(m)]) for m, ids in by_size.items()}
    longer = np.diff(cuts) > HEAD
    n, found = len(at) - 1, [np.array([], np.int64)]
    bounds = np.unique(np.concatenate([np.searchsorted(at, np.arange(0, len(data), SLICE_BYTES)), [n]]))
    for low, high in zip(bounds[:-1], bounds[1:]) if tables else ():
        begin, lengths = at[low], np.diff(at[low : high + 1])
        part = data[begin : at[high]]
        token = np.repeat(np.arange(low, high), lengths)
        place, left = np.arange(len(part)), np.repeat(at[low + 1 : high + 1] - begin, lengths) - np.arange(len(part))
        hashes, of = np.zeros(len(part), np.uint64), []
        for m in range(1, max(tables) + 1):
            keep = left >= m
            place, left, hashes = place[keep], left[keep], hashes[keep]
            if not len(place):
                break
            hashes = hashes * _STEP + part[place + (m - 1)]
            if (table := tables.get(m)) is None:
                continue
            mixed = hashes * _MIX
            near = np.flatnonzero(table.any[mixed >> table.shift])
            lead = mixed[near] >> table.shift
            start = table.first[lead]
            many = table.first[lead + np.uint64(1)] - start
            near, k = np.repeat(near, many), runs(start, many)
            same = table.hashes[k] == mixed[near]
            near, k = place[near[same]], k[same]
            same = (part[near[:, None] + np.arange(m)] == table.heads[k]).all(axis=1)
            near, k = near[same], table.ids[k[same]]
            if m == HEAD and longer[k].any():
                # the rest of a longer word, in the same token
                same = [not longer[w] or letters[cuts[w] : cuts[w + 1]].tobytes() == data[begin + i : min(begin + i + cuts[w + 1] - cuts[w], at[token[i] + 1])].tobytes() for w, i in zip(k, near)]
                near, k = near[same], k[same]
            of.append(k * n + token[near])
        if of:
            # a token's pieces are all in one slice
            pairs = np.sort(np.concatenate(of))
            found.append(pairs[once(pairs)])
    pairs = np.concatenate(found)
    del found
    pairs.sort()
    word = (pairs // max(n, 1)).astype(np.int32)
    pairs -= word.astype(np.int64) * n
    return word, pairs.astype(np.int32)


class Lists(NamedTuple):
    """The places of a block that hold each word, sorted: ``places`` from ``first`` on, ``df`` of them. Words with many also have a
    row of ``bits`` (``row``, else -1), the others have ``keys`` (word and place), sorted."""

    places: np.ndarray
    first: np.ndarray
    df: np.ndarray
    row: np.ndarray
    bits: np.ndarray
    keys: np.ndarray

    def holds(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a word is at a place, for words and places side by side."""
        row = self.row[word]
        out = (self.bits[row, place >> 3] << (place & 7).astype(np.uint8)) >= 128
        few = np.flatnonzero(row < 0)
        if len(few):
            keys = (word[few].astype(np.int64) << BLOCK_BITS) + place[few]
            k = np.searchsorted(self.keys, keys)
            out[few] = self.keys[np.minimum(k, len(self.keys) - 1)] == keys if len(self.keys) else False
        return out


def lists_of(words: pa.Array | list[bytes], tokens: pa.Array | list[bytes], cuts: np.ndarray, places: np.ndarray) -> Lists:
    """Each word's places, from those of the tokens (``places`` in a block, cut by ``cuts``)."""
    word, token = holders(words, tokens)
    sizes, n = np.diff(cuts).astype(np.int32)[token], len(words)
    sums = np.bincount(word, sizes, n).astype(np.int64)
    enough = max(FREQUENT, int(np.partition(sums, n - ROWS)[n - ROWS]) if n > ROWS else 0)
    frequent = np.flatnonzero(sums > enough)
    row = np.full(n, -1, np.int32)
    row[frequent] = np.arange(len(frequent))
    few = row[word] < 0
    keys = np.repeat(word[few].astype(np.int64) << BLOCK_BITS, sizes[few]) + places[runs(cuts[token[few]], sizes[few])]
    keys.sort()
    keys = keys[once(keys)]
    df = np.diff(np.searchsorted(keys, np.arange(n + 1) << BLOCK_BITS))
    first = np.cumsum(df) - df
    bits = np.zeros((len(frequent) + 1, 1 << (BLOCK_BITS - 3)), np.uint8)
    size, out, end = 1 << BLOCK_BITS, [(keys & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)], len(keys)
    of, token, sizes = row[word[~few]], token[~few], sizes[~few]
    del word, few
    held = np.zeros(ROWS_AT_ONCE * size, bool)
    lows = range(0, len(frequent), ROWS_AT_ONCE)
    ends = np.searchsorted(of, np.array([*lows, len(frequent)], of.dtype))
    for k, low in enumerate(lows):
        ids, at = frequent[low : low + ROWS_AT_ONCE], slice(ends[k], ends[k + 1])
        # the lists of all tokens that hold a word, one after the other
        held[:] = False
        held[np.repeat((of[at] - low).astype(np.int64) << BLOCK_BITS, sizes[at]) + places[runs(cuts[token[at]], sizes[at])]] = True
        found = np.flatnonzero(held)
        df[ids] = np.diff(np.searchsorted(found, np.arange(len(ids) + 1) << BLOCK_BITS))
        first[ids] = end + np.cumsum(df[ids]) - df[ids]
        bits[low : low + len(ids)] = np.packbits(held[: len(ids) * size].reshape(-1, size), axis=1)
        out.append((found & (size - 1)).astype(np.uint16))
        end += len(found)
    return Lists(np.concatenate(out), first, df, row, bits, keys)


def reaching(lists: Lists, codes: np.ndarray, starts: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, place, score) of all places of a block that hold ``least`` of a question's words at least (1 or more), from
    the words of all questions (``codes``, cut by ``starts``): some questions at a time, in order."""
    question = np.repeat(np.arange(len(least)), np.diff(starts))
    present = lists.df[codes] > 0
    # questions of which too few words occur at all
    present &= (np.bincount(question[present], minlength=len(least)) >= least)[question]
    codes, question = codes[present], question[present]
    order = np.argsort((question << (BLOCK_BITS + 1)) + lists.df[codes], kind="stable")
    codes = codes[order]
    size = np.bincount(question, minlength=len(least))
    first = np.cumsum(size) - size
    # all but least - 1 words, from the rarest on: a place that holds none of them can't hold enough
    rarest = np.where(size > 0, size - least + 1, 0)
    looked = np.arange(len(codes)) - first[question] < rarest[question]
    work = np.cumsum(np.bincount(question[looked], lists.df[codes[looked]], len(least)))
    done = 0
    while done < len(least):
        upto = max(int(np.searchsorted(work, (work[done - 1] if done else 0) + PAIRS, side="right")), done + 1)
        upto = min(upto, done + (1 << (31 - BLOCK_BITS)))
        at = slice(first[done], first[upto - 1] + size[upto - 1])
        words, asks = codes[at][looked[at]], question[at][looked[at]]
        df = lists.df[words]
        pairs = np.repeat((asks - done).astype(np.uint32) << BLOCK_BITS, df) | lists.places[runs(lists.first[words], df)]
        pairs.sort()
        new = np.flatnonzero(once(pairs))
        # how many of the other words may be missing
        spare = (np.diff(new, append=len(pairs)) - 1).astype(np.int32)
        pairs = pairs[new]
        others, rest = (first + rarest)[done:upto], least[done:upto] - 1
        step, found = 0, []
        while len(pairs):
            asks = (pairs >> BLOCK_BITS).astype(np.int32)
            over = rest[asks] <= step
            if over.any():
                found.append((asks[over] + done, (pairs[over] & ((1 << BLOCK_BITS) - 1)).astype(np.int64), rest[asks[over]] + 1 + spare[over]))
                pairs, spare, asks = pairs[~over], spare[~over], asks[~over]
            spare = spare - ~lists.holds(codes[others[asks] + step], (pairs & ((1 << BLOCK_BITS) - 1)).astype(np.int32))
            go = spare >= 0
            pairs, spare = pairs[go], spare[go]
            step += 1
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))
        done = upto


def _bundled(questions: pa.Table) -> bytes:
    """Questions as one value, each word of theirs once."""
    words = joined(questions["words"])
    coded = pa.ListArray.from_arrays(pa.array(starts_of(words).astype(np.int32)), words.flatten().dictionary_encode())
    sink = pa.BufferOutputStream()
    out = questions.set_column(questions.schema.get_field_index("words"), "words", coded)
    with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(out)
    return sink.getvalue().to_pybytes()


def _least_scores(long: pa.Table, asked: pa.Table) -> pa.Table:
    """Bundles of a slice's questions, with the score (1 at least) that k of some long chunks reach, and the last ord of these k."""
    words = joined(asked["words"])
    coded, starts = words.flatten().dictionary_encode(), starts_of(words)
    least, upto = np.ones(asked.num_rows, np.int32), np.full(asked.num_rows, np.iinfo(np.int64).max)
    if asked.num_rows and long.num_rows:
        tokens = pa.chunked_array([c.flatten() for c in long["tokens"].chunks], pa.binary())
        sizes = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in long["tokens"].chunks])
        distinct = joined(tokens).dictionary_encode()
        token, chunk = distinct.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(long.num_rows), sizes)
        order = np.argsort(token, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(distinct.dictionary)))])
        word, held = holders(coded.dictionary, distinct.dictionary)
        n = np.diff(cuts)[held]
        # a row of bits for each word: which of the chunks hold it
        wide = -(-long.num_rows // 8)
        ends = np.searchsorted(word, np.arange(len(coded.dictionary) + 1))
        bits = np.zeros((len(coded.dictionary), wide), np.uint8)
        for low in range(0, len(bits), 4096):
            at = slice(ends[low], ends[min(low + 4096, len(bits))])
            rows = np.zeros((len(bits[low : low + 4096]), 8 * wide), bool)
            rows[np.repeat(word[at] - low, n[at]), chunk[order][runs(cuts[held[at]], n[at])]] = True
            bits[low : low + 4096] = np.packbits(rows, axis=1)
        codes, k = coded.indices.to_numpy(zero_copy_only=False), asked["k"].to_numpy()
        ords = long["ord"].to_numpy()
        # equal scores in order of ord
        after = np.argsort(np.argsort(-ords, kind="stable"))
        by = np.argsort(-ords, kind="stable")
        for q in range(asked.num_rows):
            if k[q] <= long.num_rows:
                score_ = np.unpackbits(bits[codes[starts[q] : starts[q + 1]]], axis=1, count=long.num_rows).sum(axis=0, dtype=np.int64)
                score_, place = divmod(int(np.partition(score_ * long.num_rows + after, -k[q])[-k[q]]), long.num_rows)
                if score_:
                    least[q], upto[q] = score_, ords[by[place]]
    of = asked.select(["question_id", "k", "words"]).append_column("least", pa.array(least)).append_column("upto", pa.array(upto))
    bundles = [_bundled(of.slice(k, BUNDLE)) for k in range(0, of.num_rows, BUNDLE)]
    same = lambda name: pa.repeat(asked[name][0], len(bundles)) if bundles else pa.array([], asked[name].type)
    return pa.table({"corpus_id": same("corpus_id"), "slice": same("slice"), "part": same("part"), "bundle": pa.array(bundles, pa.binary())})


def _scored_block(postings: pa.Table, asked: pa.Table, schema: pa.Schema) -> pa.Table:
    """The first k chunks of a block for each question of a part, of those that reach its least score, as ``schema`` and corpus_id."""
    out = []
    if asked.num_rows and postings.num_rows:
        base = postings["block"][0].as_py() << BLOCK_BITS
        held = joined(postings["places"])
        places = held.flatten().to_numpy(zero_copy_only=False)
        questions = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in joined(asked["bundle"])]
        words = pa.chunked_array([c.flatten() for t in questions for c in t["words"].chunks]).cast(pa.binary())
        starts = np.concatenate([[0], np.cumsum(np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for t in questions for c in t["words"].chunks]))])
        coded = joined(words).dictionary_encode()
        of = pa.concat_tables([t.drop_columns("words") for t in questions])
        del words
        pa.default_memory_pool().release_unused()
        lists = lists_of(coded.dictionary, joined(postings["token"]), starts_of(held), places)
        k = of["k"].to_numpy()
        # of equal scores, later chunks come after those that reach it
        least = (of["least"].to_numpy() + (of["upto"].to_numpy() < base)).astype(np.int32)
        for question, place, score_ in reaching(lists, coded.indices.to_numpy(zero_copy_only=False), starts, least):
            order = np.lexsort((place, -score_, question))
            question, place, score_ = question[order], place[order], score_[order]
            rank = np.arange(len(question)) - np.searchsorted(question, question)
            best = np.flatnonzero(rank < k[question])
            ids = of.select(["question_id", "k"]).take(pa.array(question[best])).columns
            out.append(pa.table([*ids, place[best] + base, score_[best].astype(np.int32)], schema=schema))
    found = pa.concat_tables([schema.empty_table(), *out])
    same = pa.repeat(asked["corpus_id"][0], found.num_rows) if out else asked["corpus_id"].slice(0, 0)
    return found.append_column("corpus_id", same)


def ranked(questions: DataFrame, index: Index, default_k: int, most: int) -> DataFrame:
    """(question_id, corpus_id, ord, score, rank) of each question's first k chunks, without those that score 0."""
    binary: Callable[[Column], Column] = lambda w: w.cast("binary")
    kind = {f.name: f.dataType.simpleString() for f in questions.schema.fields}
    k = F.least(F.coalesce("top_k", F.lit(default_k)), F.lit(most)).cast("int").alias("k")
    asked = questions.select("question_id", "corpus_id", k, F.transform(query_words(F.coalesce("query", F.lit(""))), binary).alias("words"))
    asked = asked.where((F.size("words") > 0) & (F.col("k") > 0))
    parts = questions.count() // PART + 1
    slice_ = F.pmod(F.xxhash64("question_id"), F.lit(parts * SLICES)).cast("int")
    asked = asked.withColumn("slice", slice_).withColumn("part", F.pmod("slice", F.lit(parts)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # some blocks of the longest corpus, as many in proportion of the others
    blocks = index.blocks.groupBy("corpus_id").count().agg(F.max("count")).first()[0] or 0
    long = longest(index.texts.where(F.pmod("block", F.lit(blocks // PILOTS + 1)) == 0))
    long = long.select("corpus_id", "ord", F.transform(tokens_of(F.col("text")), binary).alias("tokens")).withColumn("slice", every(parts * SLICES))
    schema = f"corpus_id {kind['corpus_id']}, slice int, part int, bundle binary"
    bundles = long.groupBy("corpus_id", "slice").cogroup(asked.groupBy("corpus_id", "slice")).applyInArrow(_least_scores, schema)
    # names of their own, as the questions may come from the same table
    bundles = bundles.join(index.blocks.withColumn("slice", every(parts * SLICES)), ["corpus_id", "slice"]).select(*[F.col(c).alias(c) for c in ("corpus_id", "block", "part", "bundle")])
    # places in a block take two bytes
    places = F.transform("ords", lambda o: o.bitwiseAND((1 << BLOCK_BITS) - 1).cast("short"))
    lists = index.postings.select("corpus_id", "block", binary(F.col("token")).alias("token"), places.alias("places")).withColumn("part", every(parts))
    ids = questions.select("question_id").limit(0).toArrow().schema.field("question_id")
    found = pa.schema([ids.with_nullable(True), ("k", pa.int32()), ("ord", pa.int64()), ("score", pa.int32())])
    schema = f"question_id {kind['question_id']}, k int, ord long, score int, corpus_id {kind['corpus_id']}"
    key = ("corpus_id", "block", "part")
    best = lists.groupBy(*key).cogroup(bundles.groupBy(*key)).applyInArrow(lambda postings, asked: _scored_block(postings, asked, found), schema)
    best = best.select("question_id", "corpus_id", "k", "ord", "score")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "ord"))
    return best.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("rank") <= F.col("k"))).drop("k")


def retrieve(chunks: DataFrame, questions: DataFrame, index: Index, default_k: int = 4, most: int | None = None) -> DataFrame:
    """The rows of ``retrieve.retrieve``, through an index of the chunks. question_id tells questions apart; ``most`` is the
    largest k, looked up unless given."""
    if most is None:
        most = questions.agg(F.max(F.coalesce("top_k", F.lit(default_k)))).first()[0] or 0
    top = ranked(questions, index, default_k, most)
    with_chunks = chunks.join(top, ["corpus_id", "ord"])
    columns = [*chunks.columns, *[c for c in questions.columns if c != "corpus_id"], "score", "rank"]
    return with_chunks.join(questions.drop("corpus_id"), "question_id").select(*columns)
