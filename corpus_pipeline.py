"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

All stages read whole texts, treat null texts as empty, keep every input column under its own name whatever it
is called, treat repeated rows as rows, and give an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import quality_gam
from quillon.llm.common import drop_scratch, scratch_mark, staged, table
from quillon.llm.decontamination import drop_contaminated
from quillon.llm.mixing import draw_mix
from quillon.llm.sharding import shard_uniformly
from quillon.llm.similar import drop_near_duplicates


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good: a score of 0.5 or more, ties included.

    Equal texts are kept or rejected together. Without labels, or without labelled documents, all are kept."""
    return quality_gam.keep_quality(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, nulls last, and of several of
    that id an arbitrary one. Null and blank texts are one group."""
    return drop_near_duplicates(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and blank texts have none; without a benchmark all are kept."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it: 0, 1 or 2 times. Null sources are a source.
    Documents without a word add nothing to a mix; they are taken in the share of the others of their source."""
    return draw_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, which replace input columns of these names."""
    return shard_uniformly(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("near-dedup", keep_distinct),
    ("decontamination", keep_clean),
    ("mixing", mix),
    ("sharding", shard),
]
#: SQL expresses neither the classifier nor the fingerprints: tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        mark = scratch_mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
            drop_scratch(spark, since=mark, but=1)  # what the stage itself has staged is not read again
    return docs
