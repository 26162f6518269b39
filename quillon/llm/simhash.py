"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Equal fingerprints are merged
first, so copies cost nothing further. Distinct fingerprints are compared exactly, in tiles, by numpy exclusive-or
and bit counts:

* Fingerprints are dealt by keys, so that comparisons do not grow with the square of the table. Any keys do, as
  long as two fingerprints within the radius share one. ``block_keys`` gives such keys without losing a pair: the 64
  bits are cut into m > radius blocks, two fingerprints within the radius agree on m - radius of them at least, and
  each choice of m - radius blocks is a key. Of each block so many bits count that a key holds about ``RUN``
  fingerprints, whatever their number.
* The fingerprints of a key are sorted by population count and cut into tiles of ``TILE``. Tile pairs whose
  population counts differ beyond the radius are skipped, and so are those that are wholly linked already; the
  others are compared, all with all.
* A key of more than ``TASK`` fingerprints is cut over tasks, again by ranges of population counts (and by a hash
  where one count fills several), and the same pairs are skipped. What is within the radius of a few leaders is
  linked to them first and not compared with its like, so that a dense key costs no square either.

A comparison emits no more links than a spanning forest has. Links go to connected components, in the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import quoted, staged, table
from quillon.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile; in a key, about; and in a key that one task compares, at most.
TILE, RUN, TASK = 512, 2_048, 65_536
#: Choices of blocks, at most.
MAX_MASKS = 300
#: Fingerprints whose neighbours are linked first, as long as each of them has an eighth of the rest.
LEADERS = 4
#: Runs of up to so many rows are compared side by side.
SHORT = 8
#: Hashes whose bits are counted at once.
CHUNK = 65_536
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of all shingles, repeats included, signed as Spark's bigint is. Null and blank texts
    give 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z, and the six ASCII white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[shingle:]] + [len(joined)]
    hashed, spans = xxhash.xxh64_intdigest, list(zip(starts, ends))
    ones, n = np.zeros(64, dtype=np.int64), len(spans)
    for k in range(0, n, CHUNK):
        ones += bit_sums(np.array([hashed(joined[a:b], SEED) for a, b in spans[k : k + CHUNK]], dtype="<u8"))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits: bytes are spread to a byte a bit, of which 255 can be added."""
    spread = _BITS_OF_BYTE.take(hashes.view(np.uint8)).reshape(-1, 8)
    some = np.add.reduceat(spread, np.arange(0, len(hashes), 255), axis=0) if len(hashes) else spread
    return some.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with its column ``text`` replaced by ``fp``."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(x.as_py(), shingle) for x in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fps], names=[*keep, "fp"])

    return docs.mapInArrow(run, docs.select(*[quoted(c) for c in keep]).schema.add("fp", "long"))


def block_masks(m: int, radius: int, width: int = 64) -> list[int]:
    """Bit masks of every choice of m - radius of m blocks of the 64 bits; ``width`` bits of each block at most."""
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [(1 << min(edges[k + 1], edges[k] + width)) - (1 << edges[k]) for k in range(m)]
    return list(dict.fromkeys(sum(blocks[k] for k in of) for of in combinations(range(m), m - radius)))


def masks_for(n: int, radius: int, run: int = RUN) -> list[int]:
    """The masks at which n random fingerprints leave about ``run`` to a key, or less: the least m whose blocks have
    enough bits, and of these no more bits than that takes."""
    m, bits = radius + 1, max(0, (max(n, 1) // run).bit_length() - 1)
    while 64 * (m - radius) // m < bits and comb(m + 1, radius) <= MAX_MASKS:
        m += 1
    return block_masks(m, radius, -(-bits // (m - radius)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_keys(prints: DataFrame, radius: int, run: int = RUN) -> DataFrame:
    """``prints`` (node, fp, ...) once for each of its keys, with ``key``."""
    masks = masks_for(prints.count(), radius, run)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(mask)))) for i, mask in enumerate(masks)])
    return prints.select(F.explode(keys).alias("key"), *prints.columns)


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose last axis is their words."""
    x = np.bitwise_count(one ^ two)
    return x[..., 0] if x.shape[-1] == 1 else x.sum(axis=-1, dtype=np.uint16)


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a with b: the smallest position of each component."""
    while True:
        one, two = root[a], root[b]
        if not (new := one != two).any():
            return root
        a, b, up = a[new], b[new], np.arange(len(root))
        np.minimum.at(up, np.maximum(one, two)[new], np.minimum(one, two)[new])
        while (up != up[up]).any():
            up = up[up]
        root = up[root]


def tile_roots(fps: np.ndarray, radius: int, tile: int = TILE, seen: list[str] | None = None) -> np.ndarray:
    """The root (smallest position reached) of each of the fingerprints (rows of uint64 words) of one key.

    Every pair is compared but those that population counts rule out and those that are linked already. ``seen``
    gets a word for each tile pair: compared, linked or skipped."""
    n = len(fps)
    root, free = np.arange(n), np.arange(n)
    for _ in range(LEADERS):
        if len(free) < 2:
            break
        near = _apart(fps[free], fps[free[0]]) <= radius
        root[free[near]] = free[0]
        n_near, free = np.count_nonzero(near), free[~near]
        if 8 * n_near < len(near):
            break
    pop = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    led = root.copy()
    led[free] = n
    order = np.lexsort((pop, led))
    ends = [0, *(np.flatnonzero(np.diff(led[order])) + 1).tolist(), n]
    cuts = [k for lo, hi in zip(ends, ends[1:]) for k in range(lo, hi, tile)]
    tiles = np.split(order, cuts[1:])
    low, high = [int(pop[t[0]]) for t in tiles], [int(pop[t[-1]]) for t in tiles]
    for i, one in enumerate(tiles):
        for j in range(i, len(tiles)):
            two = tiles[j]
            if low[j] - high[i] > radius or low[i] - high[j] > radius:
                said = "skipped"
            elif (root[one] == (r := root[one[0]])).all() and (root[two] == r).all():
                said = "linked"
            else:
                said = "compared"
                a, b = np.nonzero(_apart(fps[one][:, None], fps[two][None, :]) <= radius)
                root = _merged(root, one[a], two[b])
            if seen is not None:
                seen.append(said)
    return root


def _batch(links: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate([*links, np.empty((0, 2), dtype=np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0], pa.int64()), pa.array(ends[:, 1], pa.int64())], names=["a", "b"])


def _forest(node: np.ndarray, fps: np.ndarray, radius: int, tile: int) -> np.ndarray:
    root = tile_roots(fps, radius, tile)
    return np.column_stack([node, node[root]])[root != np.arange(len(root))]


def _links_of_runs(radius: int, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares within each run of an equal key of a sorted partition. A run has ``TASK`` rows at most."""

    def links(key: np.ndarray, node: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        size = np.diff(cut)
        short = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT), size))
        for d in range(1, SHORT):
            short = short[short + d < len(key)]
            short = short[key[short] == key[short + d]]
            near = short[_apart(fps[short], fps[short + d]) <= radius]
            yield np.column_stack([node[near], node[near + d]])
        for k in np.flatnonzero(size > SHORT):
            yield _forest(node[cut[k] : cut[k + 1]], fps[cut[k] : cut[k + 1]], radius, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # columns of batches, of which the last key may go on
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            key = held[-1][0]
            if not len(key) or key[0] == key[-1] and (len(held) == 1 or held[0][0][-1] == key[0]):
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            done = int(np.flatnonzero(np.diff(columns[0]))[-1]) + 1
            yield _batch(list(links(columns[0][:done], columns[1][:done], np.column_stack(columns[2:])[:done].view(np.uint64))))
            held = [[c[done:] for c in columns]]
        columns = [np.concatenate(c) for c in zip(*held)]
        if columns and len(columns[0]):
            yield _batch(list(links(columns[0], columns[1], np.column_stack(columns[2:]).view(np.uint64))))

    return run


def near_links(keyed: DataFrame, radius: int = RADIUS, tile: int = TILE, task: int = TASK) -> DataFrame:
    """Links (a, b) that connect all nodes of ``keyed`` (key, node, and the words of a fingerprint: bigints) which
    share a key and are within the radius. Repeated rows and self-links do no harm."""
    spark, columns = keyed.sparkSession, keyed.columns
    large = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > task).select("key"), "simhash-large")
    several = not large.isEmpty()
    small = keyed.join(large, "key", "left_anti").select(*columns) if several else keyed
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = small.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links_of_runs(radius, tile), "a long, b long")
    return links.unionByName(_links_over_tasks(staged(keyed.join(large, "key").select(*columns), "simhash-hot"), radius, tile, task)) if several else links


def _links_over_tasks(keyed: DataFrame, radius: int, tile: int, task: int) -> DataFrame:
    """Links within keys of more than a task's rows: to a few leaders, and of every pair of half tasks that population
    counts and leaders do not rule out. A half task is a range of population counts, or, where one count alone is
    more, a part of it by hash."""
    columns, fps, half = keyed.columns, keyed.columns[2:], max(1, task // 2)
    rows = keyed.withColumns({"led": F.lit(None).cast("long"), "pop": sum((F.bit_count(c).cast("int") for c in fps), F.lit(0))})
    for _ in range(LEADERS):
        # one row a large key
        lead = rows.where("led IS NULL").groupBy("key").agg(F.min(F.struct(*columns[1:])).alias("l"))
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"l.{c}"))).cast("int") for c in fps), F.lit(0))
        near = F.when(apart <= radius, F.col("l.node"))
        rows = staged(rows.join(staged(lead, "simhash-leaders"), "key", "left").withColumn("led", F.coalesce("led", near)).drop("l"), "simhash-led")
    linked = rows.where("led <> node").select(F.col("node").alias("a"), F.col("led").alias("b"))
    of = ["key", "led"]
    counts = rows.groupBy(*of, "pop").agg(F.count("*").alias("n"))
    upto = F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy("pop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = staged(counts.select(*of, "pop", F.floor(upto / half).alias("range"), F.ceil(F.col("n") / half).cast("int").alias("cuts")), "simhash-cuts")
    ranges = cuts.groupBy(*of, "range").agg(F.min("pop").alias("low"), F.max("pop").alias("high"), F.max("cuts").alias("most"))
    tiles = ranges.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).select("key", F.struct("led", "range", "cut").alias("tile"), "low", "high")
    two = tiles.select("key", *[F.col(c).alias(f"{c}2") for c in ("tile", "low", "high")])
    # an equality join on the key: pairs of half tasks, not of rows
    ruled_out = (F.col("low2") - F.col("high") > radius) | (F.col("low") - F.col("high2") > radius) | F.coalesce(F.col("tile.led") == F.col("tile2.led"), F.lit(False))
    pairs = tiles.join(two, "key").where((F.col("tile2") >= F.col("tile")) & ~ruled_out)
    to = pairs.select("key", F.xxhash64("tile", "tile2").alias("pair"), F.explode(F.array_distinct(F.array("tile", "tile2"))).alias("tile"))
    cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    same = (F.col("r.key") == F.col("c.key")) & F.col("r.led").eqNullSafe(F.col("c.led")) & (F.col("r.pop") == F.col("c.pop"))
    placed = rows.alias("r").join(cuts.alias("c"), same).select("r.*", F.struct(F.col("r.led").alias("led"), "range", cut.alias("cut")).alias("tile"))
    on = (F.col("p.key") == F.col("t.key")) & F.col("p.tile").eqNullSafe(F.col("t.tile"))
    dealt = placed.alias("p").join(to.alias("t"), on).select("p.key", "t.pair", *[F.col(f"p.{c}") for c in columns[1:]])

    def of_pair(group: pd.DataFrame) -> pd.DataFrame:
        words = np.column_stack([group[c].to_numpy(np.int64) for c in fps]).view(np.uint64)
        return pd.DataFrame(_forest(group["node"].to_numpy(np.int64), words, radius, tile), columns=["a", "b"])

    return linked.unionByName(dealt.groupBy("key", "pair").applyInPandas(of_pair, "a long, b long"))


def fingerprint_groups(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, run: int = RUN, task: int = TASK) -> DataFrame:
    """``prints`` (fp, doc_id, ...) with ``component_id``: the smallest doc_id that links reach, null where
    no document of the component has an id."""
    firsts = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    links = near_links(block_keys(firsts.select(F.col("fp").alias("node"), "fp"), radius, run), radius, tile, task)
    roots = staged(connected_components(links), "simhash-roots")
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = staged(rooted.join(least, "root").select("fp", "component_id"), "simhash-of")
    return prints.join(of, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, run: int = RUN, task: int = TASK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Null and blank texts share the fingerprint zero and link to what is within the radius of it. Null ids
    take part and get their component's smallest id. Equal rows are rows of one component each; texts are
    read whole; an empty table gives an empty one; other columns are ignored."""
    prints = staged(with_fingerprints(docs.select("doc_id", "text"), shingle), "simhash-docs")
    return fingerprint_groups(prints, radius, tile, run, task).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
