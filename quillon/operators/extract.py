"""Extraction of claims: a catalog of detectors fanned out over chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.detectors import SETS, Detector, claims


def extract(chunks: DataFrame, detectors: str | Sequence[Detector] = "base") -> DataFrame:
    """One row per claim: the chunk's columns, ``pos`` (the detector's place in its set) and the claim's fields.

    A chunk without claims, or with a null text, gives no row. A null kind is prose."""
    of = SETS[detectors] if isinstance(detectors, str) else detectors
    if not of:
        raise ValueError("no detectors")
    text, kind = F.col("text"), F.coalesce("kind", F.lit("prose"))
    # outer, as else the optimiser adds a filter that computes all claims a second time
    out = chunks.withColumn("__found", F.explode_outer(F.filter(claims(of, text, kind), lambda x: x["claim"].isNotNull()))).where("__found IS NOT NULL")
    return out.select(*[c for c in chunks.columns if c != "text"], "__found.pos", "__found.claim.*")
