"""Presentation over a stream: the deferred first one, and attempts with error recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.streaming.ordered import OrderedFold, folded

LIMIT_US = 100_000


class FirstPresent(OrderedFold):
    """The first presentation of a key: at the first scale from its first surface on, or when the limit has passed.

    State: the surface's time, -1 before there is one, and whether it is presented."""

    OUT = "key string, present_us long, cause string"
    STATE = "surface long, done boolean"
    EVENT = "kind string"

    def __init__(self, limit_us: int) -> None:
        self.limit_us = limit_us

    def start(self) -> tuple:
        return -1, False

    def step(self, state: tuple, us: int, event_id: int, event: tuple) -> tuple[tuple, tuple | None]:
        surface, done = state
        if event[0] == "surface" and surface < 0:
            # a scale at the same time may have come before it
            return (us, done), None
        if event[0] == "scale" and surface >= 0 and not done:
            return (surface, True), (us, "scale")
        return state, None

    def due(self, state: tuple) -> int | None:
        surface, done = state
        return None if surface < 0 or done else surface + self.limit_us + 1

    def expire(self, state: tuple) -> tuple[tuple, tuple | None]:
        return (state[0], True), (state[0] + self.limit_us, "limit")


def deferred_present_stream(events: DataFrame, key: str, limit_us: int = LIMIT_US, late: str = "0 seconds") -> DataFrame:
    """A stream of ``events`` (key, ts, kind: surface or scale) -> one row per key: when it is first presented,
    and why. The limit runs in event time; events may arrive in any order within ``late``."""
    of = events.withColumn("event_id", F.when(F.col("kind") == "surface", 0).otherwise(1).cast("long"))  # surfaces first
    return folded(of, key, late, FirstPresent(limit_us), "kind")


def present_step(state: tuple, tag: str | None, error: str | None, recreate: bool) -> tuple[tuple, str | None]:
    """One attempt: state (status, armed error or "", presented, recreated) -> state, result."""
    status, armed, presented, recreated = state
    if recreate:
        status, recreated = "Ready", recreated + 1
    armed = error or armed
    if tag is None:
        return (status, armed, presented, recreated), None
    if armed:
        return (armed if armed in ("SurfaceLost", "DeviceLost") else status, "", presented, recreated), armed
    drawn = tag in ("Cpu", "DeviceEncoded")
    return (status, "", presented + drawn, recreated), "Presented" if drawn else "Skipped"


class Present(OrderedFold):
    """Results of attempts, as ``operators.present.present`` has them."""

    OUT = "key string, event_id long, result string, status string, present_count long, recreate_count long"
    STATE = "status string, armed string, presented long, recreated long"
    EVENT = "frame_tag string, inject_error string, recreate boolean"

    def start(self) -> tuple:
        return "Ready", "", 0, 0

    def step(self, state: tuple, us: int, event_id: int, event: tuple) -> tuple[tuple, tuple]:
        tag, error, recreate = event
        state, result = present_step(state, tag, error, bool(recreate))
        return state, (event_id, result, state[0], state[2], state[3])


def present_stream(events: DataFrame, key: str, late: str = "0 seconds") -> DataFrame:
    """A stream of ``events`` (key, ts, event_id, frame_tag, inject_error, recreate) -> results, in append mode, in any
    order of arrival within ``late``."""
    return folded(events, key, late, Present(), "frame_tag", "inject_error", "recreate")


def present_to(results: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes the frames that were presented to Parquet files in ``sink``, for what is there now, and ends."""
    shown = results.where("result = 'Presented'")
    return shown.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
