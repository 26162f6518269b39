"""Near-duplicates by similarity of word shingles: SimHash finds who is compared, sets of shingles decide.

Two texts are near-duplicates if their sets of five-word shingles have a similarity (Jaccard) of 0.8 or more. A
64-bit fingerprint cannot tell that from 0.6, and its radius is too wide for block keys. So fingerprints have 256
bits here, and are dealt by keys of their shingle sets instead: each key is the least hashes of the set under
``ROWS`` functions, and a set has ``BANDS`` of them. Sets of similarity s share a key with probability
1 - (1 - s^4)^24: all but 1 pair in 300,000 at 0.8. The number of keys is the same for every text, so keys and
comparisons grow in proportion to the texts; a passage that many texts share makes no hot key unless it makes
most of them. Within a key, fingerprints are compared in tiles, as ``simhash`` has it, within a radius that all but
1 pair in a million at 0.8 keep to.

What is linked that way makes candidate groups. Within a group shingle sets are compared exactly, all with all, by
counting common shingles through an index. A group of one tile (``TEXTS`` texts and ``TEXT_BYTES`` bytes) takes one
task. A larger group is compared in two rounds: first each of its tiles by itself, together with a few texts that
all of its tiles get; then, only where that leaves several classes of similar texts, pairs of tiles that are not
of one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quillon.llm.common import quoted, staged, without
from quillon.llm.components import connected_components
from quillon.llm.simhash import TASK, TILE, _batch, bit_sums, near_links

SHINGLE, SIMILARITY = 5, 0.8
#: Keys of a text, and least hashes that make a key.
BANDS, ROWS = 24, 4
#: 64-bit words of a fingerprint, and differing bits at most. A bit of two sets of similarity 0.8 differs with
#: probability 0.15, of short ones (a set of four in one of five) 0.19: five standard deviations more are 80.
WORDS, RADIUS = 4, 80
#: Texts and bytes of a tile of texts that are compared exactly, and texts of a large group that all its tiles get.
TEXTS, TEXT_BYTES, PIVOTS = 4_096, 16 << 20, 16
#: Shingles whose least hashes are taken at once.
CHUNK = 4_096

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)
_SHIFTS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * _ODD[1])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z, and the six ASCII white-space bytes


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than n make one, none make none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(n, len(w))
    total = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for at in range(k):
        total = total * _ODD[0] + w[at : len(w) - k + 1 + at]
    return np.unique(mixed(total))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` signed words: bits that over half of the hashes have, each word under a function of its own."""
    ones = [bit_sums(mixed(hashes ^ x)) for x in _SHIFTS]
    return np.packbits(2 * np.concatenate(ones) > len(hashes), bitorder="little").view("<i8")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` signed keys; none of an empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for k in range(0, len(hashes), CHUNK):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, k : k + CHUNK]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for of in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * _ODD[0] + of)
    return keys.view(np.int64)


_FPS = [f"f{k}" for k in range(WORDS)]


def with_measures(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` (__row, doc_id, text) with the text replaced by two halves of a hash of its words (h1, h2), their
    bytes, the fingerprint (f0, f1, ...) and the keys."""
    kinds = {"h1": pa.int64(), "h2": pa.int64(), "bytes": pa.int64(), **dict.fromkeys(_FPS, pa.int64()), "keys": pa.list_(pa.int64())}
    schema = rows.select("__row", "doc_id").schema
    for name in kinds:
        schema = schema.add(name, ArrayType(LongType()) if name == "keys" else LongType())

    def measure(text: str | None) -> tuple:
        words = words_of(text)
        joined, hashes = b" ".join(words), shingle_hashes(words, shingle)
        halves = np.frombuffer(xxhash.xxh3_128_digest(joined), dtype="<i8").tolist()
        return (*halves, len(joined), *wide_fingerprint(hashes).tolist(), band_keys(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*(measure(x.as_py()) for x in b.column("text")))) or [()] * len(kinds)
            columns = [pa.array(m, k) for m, k in zip(made, kinds.values())]
            yield pa.RecordBatch.from_arrays([b.column("__row"), b.column("doc_id"), *columns], names=["__row", "doc_id", *kinds])

    return rows.mapInArrow(run, schema)


def candidate_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, task: int = TASK) -> DataFrame:
    """Links (a, b) of ``nodes`` (node, keys, fingerprint): those that share a key and are within the radius."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    # most keys are those of one text: they go before anything else is attached
    shared = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key")
    return near_links(staged(shared.join(nodes.select("node", *_FPS), "node").select("key", "node", *_FPS), "similar-keyed"), radius, tile, task).distinct()


def similar_roots(hashes: list[np.ndarray], least: float) -> np.ndarray:
    """The root (a position) of each of the shingle sets (sorted distinct hashes): sets of similarity ``least`` or
    more are linked. Common shingles are counted through an index of all sets; two empty sets are alike."""
    size = np.array([len(h) for h in hashes], dtype=np.int64)
    root = np.arange(len(hashes))
    root[size == 0] = np.flatnonzero(size == 0)[:1]
    if not size.sum():
        return root
    _, term = np.unique(np.concatenate(hashes), return_inverse=True)
    owner = np.repeat(np.arange(len(hashes)), size)[np.argsort(term, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(term))])
    of = np.split(term, np.cumsum(size)[:-1])
    rest = size > 0
    while rest.any():
        first = int(np.argmax(rest))
        queue, rest[first] = [first], False
        while queue and rest.any():
            one = queue.pop()
            common = np.bincount(np.concatenate([owner[start[t] : start[t + 1]] for t in of[one]]), minlength=len(hashes))
            found = np.flatnonzero(rest & (common > 0) & (common >= least * (size + size[one] - common) - 1e-9))
            root[found] = first
            queue += found.tolist()
            rest[found] = False
    return root


def _compared(rows: DataFrame, dealt: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links among the texts of each tile. ``dealt``: __row, node, tile."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by a merge join at any size: ids grow with the rows
    sent = rows.join(dealt.hint("merge"), "__row").select("tile", "node", "text").repartition(parts, "tile").sortWithinPartitions("tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        each = ((p.as_py(), x.as_py(), t.as_py()) for b in batches for p, x, t in zip(*b.columns))
        for _, of in groupby(each, lambda r: r[0]):
            nodes, hashes = zip(*((x, shingle_hashes(words_of(t), shingle)) for _, x, t in of))
            if len(nodes) > 1:
                found += [(nodes[a], nodes[b]) for a, b in enumerate(similar_roots(list(hashes), least).tolist()) if a != b]
            if len(found) > 10_000:
                yield _batch([np.array(found, dtype=np.int64)])
                found = []
        yield _batch([np.array(found, dtype=np.int64).reshape(-1, 2)])

    return sent.mapInArrow(run, "a long, b long")


def similar_links(rows: DataFrame, groups: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, texts: int = TEXTS, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Links (a, b) that connect all similar nodes of each group. ``rows``: __row, text; ``groups``: root, node,
    __row, bytes, a node once."""
    cuts = lambda n, size: F.greatest(F.ceil(n / texts), F.ceil(size / text_bytes), F.lit(1)).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    sums = groups.groupBy("root").agg(cuts(F.count("*"), F.sum("bytes")).alias("cuts"))
    cut = staged(groups.join(sums, "root"), "similar-groups")
    alone = cut.select("__row", "node", F.xxhash64("root", part(F.col("cuts"))).alias("tile"))
    large = cut.where("cuts > 1")
    if large.isEmpty():
        return _compared(rows, alone, shingle, least)
    # a few texts of each large group go to all of its tiles
    pivots = large.groupBy("root", "cuts", part(F.lit(PIVOTS)).alias("of")).agg(F.min(F.struct("node", "__row")).alias("p"))
    spread = pivots.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("p.__row", "p.node", F.xxhash64("root", "cut").alias("tile"))
    first = staged(_compared(rows, alone.unionByName(spread).distinct(), shingle, least), "similar-first")
    found = staged(connected_components(first), "similar-classes").withColumnRenamed("root", "class")
    classed = large.drop("cuts").join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    # classes of half a tile or more are cut into half tiles of their own; the others share half tiles
    sizes = classed.groupBy("root", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = sizes.withColumn("own", (2 * F.col("n") >= texts) | (2 * F.col("bytes") >= text_bytes)).withColumn("of", F.when(F.col("own"), F.col("class")))
    whole = Window.partitionBy("root", "of")
    sizes = sizes.withColumn("parts", cuts(2 * F.sum("n").over(whole), 2 * F.sum("bytes").over(whole)))
    sizes = staged(sizes.withColumn("several", F.count("*").over(Window.partitionBy("root")) > 1).where("several"), "similar-sizes")
    halves = sizes.select("root", "of", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", F.struct("of", "part").alias("half"))
    pairs = halves.join(halves.select("root", F.col("half").alias("half2")), "root")
    pairs = pairs.where((F.col("half2") >= F.col("half")) & ~F.coalesce(F.col("half.of") == F.col("half2.of"), F.lit(False)))
    to = pairs.select("root", F.xxhash64("root", "half", "half2").alias("tile"), F.explode(F.array_distinct(F.array("half", "half2"))).alias("half"))
    placed = classed.join(sizes.select("root", "class", "of", "parts"), ["root", "class"]).withColumn("half", F.struct("of", part(F.col("parts")).alias("part")))
    again = placed.alias("p").join(to.alias("t"), (F.col("p.root") == F.col("t.root")) & F.col("p.half").eqNullSafe(F.col("t.half")))
    return first.unionByName(_compared(rows, again.select("p.__row", "p.node", "t.tile"), shingle, least))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, tile: int = TILE, task: int = TASK, texts: int = TEXTS, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id (nulls last), of equal ids an
    arbitrary but fixed one. All columns of ``docs`` stay, whatever their names but ``__row``.

    Texts of the same words, by a 128-bit hash, are one node; null and blank texts are one. Nodes are linked if
    their sets of ``shingle``-word shingles have similarity ``least``. Texts are read whole; an empty table stays
    empty. The keys are made for a similarity of 0.8: a lower ``least`` finds fewer of its pairs."""
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "similar-rows")
    prints = staged(with_measures(rows.select("__row", "doc_id", "text"), shingle), "similar-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("first")
    nodes = prints.groupBy("h1", "h2").agg(first, *[F.min(c).alias(c) for c in ("bytes", *_FPS, "keys")])
    nodes = staged(nodes.withColumn("node", F.col("first.__row")), "similar-nodes")
    links = candidate_links(nodes.select("node", "keys", *_FPS), radius, tile, task)
    groups = connected_components(links).join(nodes.select("node", F.col("node").alias("__row"), "bytes"), "node")
    links = similar_links(rows.select("__row", "text"), groups, shingle, least, texts, text_bytes)
    roots = staged(connected_components(links), "similar-roots")
    rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(kept.hint("merge"), "__row", "left_semi").select(*[quoted(c) for c in without(docs, "__row").columns])
