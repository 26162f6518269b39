"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target in words, at most ``CAP`` times its size. Whole passes over the source come
first; what remains of the target is a subset-sum problem over the histogram of exact document lengths:
every length gives its share of documents, a seeded round of single documents brings the remainder down to
``DP_WORDS``, and a bounded-knapsack dynamic programme over lengths fits it exactly where that is possible.
Which documents of a length are taken is a matter of a seeded hash: those up to the k-th smallest.

Only lengths, counts and hashes are shuffled. Texts are read twice and never move.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import quoted, staged, table, without, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 77
#: Words that the dynamic programme fits, at most (and the longest document more).
DP_WORDS = 32_768
#: Tables of up to so many bytes are broadcast; larger ones are joined by a shuffle over salted keys.
BROADCAST_BYTES = 32 << 20
SALTS = 32
ADDED = ("size", "source_size", "target", "times", "taken")


def source_targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> those with ``target``: ``share`` of all sizes by weight, where no source is
    above ``cap`` times its size and what that cuts off is shared by weight among the others.

    Weights repeat over the sources in code point order, null last. Sources may be many: they are ranked over
    sorted partitions, and the level at which the targets add up is found by sums over all of them, each of which
    finds more of the sources that are at their most."""
    weight = F.element_at(F.lit([float(w) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)
    out = _ranked(sizes, F.col("source").isNull(), F.col("source")).withColumn("w", weight)
    out = staged(out.select("source", "source_size", "w", (F.col("source_size") * float(cap)).alias("most")), "mix-sources")
    budget, level, before = share * float(out.agg(F.sum("source_size")).first()[0] or 0), 0.0, None
    full = lambda: F.col("most") <= F.col("w") * level
    while before != level:
        before = level
        n, at_most, open_ = out.agg(F.count_if(~full()), F.sum(F.when(full(), F.col("most"))), F.sum(F.when(~full(), F.col("w")))).first()
        if not n:
            break
        level = max(level, (budget - (at_most or 0.0)) / open_)
    return out.select("source", "source_size", F.least("most", F.col("w") * level).alias("target"))


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` (from 0) in this order: partitions by range, and a number for each row of a partition.
    One row a partition is summed up."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "mix-ranks")
    numbered = numbered.withColumn("__part", F.shiftright("__id", 33))
    sums = numbered.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a partition, of which there are shuffle.partitions
    return numbered.join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part").withColumn("rank", F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__before")


def fit_lengths(sizes: np.ndarray, counts: np.ndarray, target: float, cap: int = CAP, seed: int = SEED) -> tuple[int, np.ndarray]:
    """Whole passes, and how many documents of each length to take once more, for a sum near ``target``."""
    total = int((sizes * counts).sum())
    extra = np.zeros(len(sizes), dtype=np.int64)
    if not total:
        return 0, extra
    passes = min(cap, int(target // total))
    left = round(target) - passes * total
    if passes == cap or left <= 0:
        return passes, extra
    extra = np.minimum(counts, np.floor(counts * (left / total)).astype(np.int64))
    left -= int((extra * sizes).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))
    for j in order:
        if left <= DP_WORDS:
            break
        if 0 < sizes[j] <= left and extra[j] < counts[j]:
            extra[j] += 1
            left -= int(sizes[j])
    return passes, extra + _knapsack(sizes, counts - extra, left, order)


def _knapsack(sizes: np.ndarray, free: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """How many of each length to take for the sum nearest to ``budget``, of equally near ones the smaller.
    Bit s of a number says that sum s can be reached; counts are split into powers of two."""
    taken = np.zeros(len(sizes), dtype=np.int64)
    open_ = [int(j) for j in order if free[j] > 0 and sizes[j] > 0]
    if budget <= 0 or not open_:
        return taken
    most = budget + min(max(int(sizes[j]) for j in open_), DP_WORDS)
    reach, mask, steps = 1, (1 << (most + 1)) - 1, []
    for j in open_:
        size, bundle = int(sizes[j]), 1
        n = min(int(free[j]), most // size)
        while n > 0 and not reach >> budget & 1:
            take = min(bundle, n)
            steps.append((j, take, reach))
            reach |= reach << (size * take) & mask
            n, bundle = n - take, bundle * 2
        if reach >> budget & 1:
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    over = reach >> (budget + 1)
    above = budget + (over & -over).bit_length() if over else None
    at = below if above is None or budget - below <= above - budget else above
    # a document longer than all sums looked at may still be the nearest
    if (long := min((int(sizes[j]) for j in open_ if sizes[j] > most), default=None)) is not None and long - budget < abs(at - budget):
        taken[next(j for j in open_ if sizes[j] == long)] = 1
        return taken
    for j, take, before in reversed(steps):
        if not before >> at & 1:
            taken[j] += take
            at -= int(sizes[j]) * take
    return taken


def _joined(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys that may be null and may be hot: by a broadcast where ``small`` has BROADCAST_BYTES at
    most (of text, and 16 for every other value), else over salted keys."""
    bytes_ = sum((F.octet_length(F.coalesce(c, F.lit(""))) if t == "string" else F.lit(16) for c, t in small.dtypes), F.lit(8))
    if (small.agg(F.sum(bytes_)).first()[0] or 0) <= BROADCAST_BYTES:
        return _null_safe(rows, F.broadcast(small), keys, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return _null_safe(rows.withColumn("__salt", F.pmod("__key", F.lit(SALTS)).cast("int")), salted, [*keys, "__salt"], how).drop("__salt")


def _null_safe(rows: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    small = small.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return rows.join(small, on, how).drop(*[f"__r_{k}" for k in keys])


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def mix_sources(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, times (0 to ``cap``) and taken (times x size).

    A null text has size 0, a null source is a source of its own. Rows that are equal in id and text are
    taken or left together. Without words all targets and times are 0. Input columns of the added names are
    replaced. The result depends on the rows alone, not on their order or partitions."""
    docs = without(docs, *ADDED)
    sized = docs.withColumns({"size": word_count(F.col("text")), "__key": _key(seed)})
    rows = staged(sized.select("source", "size", "__key"), "mix-rows")
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = staged(source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, cap, weights), "mix-targets")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        passes, extra = fit_lengths(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), float(group["target"].iloc[0]), cap, seed)
        return group[["source", "size", "n"]].assign(passes=passes, extra=extra)

    # a group is the distinct lengths of one source
    wanted = _joined(lengths.withColumn("__key", F.xxhash64("size")), targets.select("source", "target"), ["source"]).drop("__key")
    plan = staged(wanted.groupBy("source").applyInPandas(fit, "source string, size long, n long, passes int, extra long"), "mix-plan")
    plan = _with_cuts(rows, plan)
    out = _joined(_joined(sized, plan, ["source", "size"]), targets, ["source"])
    times = F.col("passes") + F.coalesce(F.col("__key") <= F.col("cut"), F.lit(False)).cast("int")
    return out.withColumn("times", times).withColumn("taken", F.col("size") * times).select(*[quoted(c) for c in docs.columns], *ADDED)


def _with_cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``cut``: the ``extra``-th smallest key of each source and length. Keys are first counted by their
    top bits, so that a length shared by any number of rows is ranked in small parts."""
    some = plan.where((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).select("source", "size", "extra")
    among = _joined(rows, some, ["source", "size"]).withColumn("top", F.shiftright("__key", 54))
    per = Window.partitionBy("source", "size").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    tops = among.groupBy("source", "size", "extra", "top").agg(F.count("*").alias("here"))
    tops = tops.withColumn("before", F.coalesce(F.sum("here").over(per), F.lit(0)))
    edge = staged(tops.where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("here"))).select("source", "size", "top", (F.col("extra") - F.col("before")).alias("rank")), "mix-edges")
    near = _joined(among.drop("extra"), edge, ["source", "size", "top"])
    ranked = near.withColumn("at", F.row_number().over(Window.partitionBy("source", "size", "top").orderBy("__key")))
    cuts = ranked.where("at = rank").select("source", "size", F.col("__key").alias("cut"))
    whole = plan.where((F.col("extra") > 0) & (F.col("extra") >= F.col("n"))).select("source", "size", F.lit((1 << 63) - 1).alias("cut"))
    cuts = staged(cuts.unionByName(whole), "mix-cuts")
    return staged(_null_safe(plan.select("source", "size", "passes"), cuts, ["source", "size"], "left"), "mix-cut-plan")


def draw_mix(docs: DataFrame, **how: object) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix_sources`` says, with all its columns."""
    rows = docs.select("doc_id", "source", "text", F.struct(*[quoted(c) for c in docs.columns]).alias("__doc"))
    mixed = mix_sources(rows, **how).where("times > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("__doc.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
