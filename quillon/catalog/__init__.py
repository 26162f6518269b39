"""The registered queries of the evidence and event-state operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.catalog import claims, compat, events, evidence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = evidence.QUERIES | claims.QUERIES | events.QUERIES | compat.QUERIES
ORACLES: dict[str, str] = evidence.ORACLES | claims.ORACLES | events.ORACLES | compat.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["answer_primary"](spark, sf_dir)
