"""Presentation with error recovery, over ordered attempts per key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.compat import mock_negotiate, negotiate

LOSSES = ("SurfaceLost", "DeviceLost")
DRAWN = ("Cpu", "DeviceEncoded")


def present(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``events`` (key, order, recreate, inject_error, frame_tag) with ``result`` (Presented, Skipped, an error's
    name, or null without a frame), ``status``, ``present_count`` and ``recreate_count`` after the event.

    Within an event the surface is recreated first, then an error is armed, then the frame is presented. An
    armed error is consumed by the next frame, once; arming again replaces it. Losses set the status,
    recreation resets it, success does neither."""
    here = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    frame = F.col("frame_tag").isNotNull()
    out = events.withColumn("__frames", F.coalesce(F.sum(frame.cast("int")).over(before), F.lit(0)))
    armed = Window.partitionBy(key, "__frames").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("__error", F.last("inject_error", ignorenulls=True).over(armed))
    drawn = F.when(F.col("frame_tag").isin(*DRAWN), "Presented").otherwise("Skipped")
    out = out.withColumn("result", F.when(frame, F.coalesce("__error", drawn)))
    change = F.when(F.col("result").isin(*LOSSES), F.col("result")).when(F.coalesce("recreate", F.lit(False)), "Ready")
    return out.withColumns({
        "status": F.coalesce(F.last(change, ignorenulls=True).over(here), F.lit("Ready")),
        "present_count": F.sum(F.when(F.col("result") == "Presented", 1).otherwise(0)).over(here),
        "recreate_count": F.sum(F.coalesce("recreate", F.lit(False)).cast("int")).over(here),
    }).drop("__frames", "__error")


class Renderer(Protocol):
    """What presents frames: its surface, what it says to a frame source before that is prepared (without effect), the
    outcome of every attempt, and its health after them."""

    surface_format: str
    surface_size: tuple[int, int]

    def negotiate(self, source_kind: Column) -> Column: ...

    def present(self, events: DataFrame, key: str, order: Sequence[str]) -> DataFrame: ...

    def status(self, presented: DataFrame, key: str, order: Sequence[str]) -> DataFrame: ...


@dataclass(frozen=True)
class TableRenderer:
    """A renderer whose attempts are rows; its defaults are those of the mock renderer."""

    surface_format: str = "Bgra8Unorm"
    surface_size: tuple[int, int] = (1920, 1080)
    mock: bool = True

    def negotiate(self, source_kind: Column) -> Column:
        return mock_negotiate() if self.mock else negotiate(source_kind)["tag"]

    def present(self, events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
        return present(events, key, order)

    def status(self, presented: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
        """(key, status, present_count) after the last attempt of each key."""
        last = F.max_by(F.struct("status", "present_count"), F.struct(*order)).alias("last")
        return presented.groupBy(key).agg(last).select(key, "last.*")
