"""Uniform random sharding by a hypergeometric communication matrix.

Rows lie in input partitions. The number of rows that partition p sends to shard s is drawn from the
multivariate hypergeometric law that a uniformly random permutation of all rows would give, with row
sums (partition sizes) and column sums (shard sizes) exact. Each partition then permutes its rows
locally and deals them out by its row of the matrix; each shard permutes what it received. The result
is a uniform shuffle whose shard sizes differ by one at most.

Only counts (one per input partition, folded into at most ``MAX_PARTS`` cells) reach the driver. Row
payloads move once, in the join that attaches shard and slot; everything else moves narrow row ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import quoted, staged, table, without

N_SHARDS = 8
SEED = 20_240_611
#: Input partitions are folded into so many cells at most: the matrix has MAX_PARTS x shards entries.
MAX_PARTS = 16_384
#: Rows up to which numpy draws the hypergeometric law.
GENERATOR_ROWS = 1_000_000_000
#: A shard is permuted in random blocks of about so many rows, one task each.
ROWS_PER_BLOCK = 1_000_000


def communication_matrix(parts: dict[int, int], n_shards: int, seed: int) -> dict[int, list[int]]:
    """Draws the partition-to-shard counts, as running sums over the shards, for partition sizes ``parts``.

    Shard sizes are exact and differ by one at most; the larger shards come first."""
    total = sum(parts.values())
    room = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    drawn = {}
    for p in sorted(parts):
        got = _draw(room, parts[p], rng)
        room = room - got
        drawn[p] = [int(x) for x in np.cumsum(got)]
    return drawn


def _draw(room: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """One multivariate hypergeometric draw, shard by shard."""
    got, left = np.zeros_like(room), int(room.sum())
    for s, cap in enumerate(room.tolist()):
        rest = left - cap
        got[s] = hypergeometric(cap, rest, n, rng)
        n, left = n - int(got[s]), rest
    return got


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n rows drawn without replacement are good: numpy's generator within its range of 10^9 rows, beyond
    it inversion of the same law."""
    if not n or not good:
        return 0
    if good + bad < GENERATOR_ROWS:
        return int(rng.hypergeometric(good, bad, n))
    first, law = hypergeometric_law(good, bad, n)
    upto = np.cumsum(law)
    return first + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def hypergeometric_law(good: int, bad: int, n: int) -> tuple[int, np.ndarray]:
    """The probabilities of first, first + 1, ... good rows, up to a common factor: all within twelve standard
    deviations of the mode. What lies beyond has less than 10^-30 together, under the steps of a drawn number.

    Each comes from its neighbour by the exact ratio of the two, so that nothing is lost to factorials of large
    numbers."""
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 50 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    first, last = max(0, n - bad, mode - reach), min(good, n, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) / (k + 1) * ((n - k) / (bad - n + k + 1)))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    return first, np.exp(logs - logs.max())


def shard_uniformly(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within
    its shard, in random order).

    Nulls, equal rows and very long texts are rows like any other; an empty table stays empty; with fewer
    rows than shards some shards stay empty. Input columns named shard or slot are replaced. The same input
    files in the same partitions give the same result."""
    spark = docs.sparkSession
    docs = without(docs, "shard", "slot", "__part", "__row")
    rows = staged(docs.withColumns({"__part": F.pmod(F.spark_partition_id(), F.lit(MAX_PARTS)), "__row": F.monotonically_increasing_id()}), "shard-rows")
    ids = rows.select("__part", "__row")
    parts = {r["__part"]: r["n"] for r in ids.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix(parts, n_shards, seed)
    sent = spark.createDataFrame([(p, c) for p, c in matrix.items()], "__part int, __sent array<bigint>")
    blocks = max(1, -(-sum(parts.values()) // (n_shards * rows_per_block)))

    local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed), "__row"), "__row")
    rank = F.row_number().over(local).cast("long") - 1
    # at most MAX_PARTS rows of n_shards counts: bounded whatever the input
    dealt = ids.withColumn("__rank", rank).join(F.broadcast(sent), "__part")
    dealt = staged(dealt.select(
        "__row",
        F.size(F.filter("__sent", lambda upto: upto <= F.col("__rank"))).alias("shard"),
        F.xxhash64(F.lit(seed + 1), "__row").alias("__key"),
    ).withColumn("__block", F.pmod(F.shiftright("__key", 32), F.lit(blocks)).cast("int")), "shard-dealt")
    per_block = dealt.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per block of a million rows: read as a table, joined as any other
    placed = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("shard", "__block").orderBy("__key", "__row")).cast("long") - 1)
    placed = placed.join(per_block.withColumn("__from", before), ["shard", "__block"]).select("__row", "shard", (F.col("__from") + F.col("__at")).alias("slot"))
    return rows.join(placed, "__row").select(*[quoted(c) for c in docs.columns], "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder per shard, its rows in slot order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_uniformly(sized).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
