"""The lifecycle automaton over a stream: one small state per key, surface size included."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.streaming.ordered import OrderedFold, folded


class Step(NamedTuple):
    outcome: str
    phase: str
    output: str | None


def step(phase: str, shown: bool, op: str | None, is_first_frame: bool = False) -> Step:
    """One event; ``shown`` is whether a frame has been rendered before."""
    if op == "prepare":
        return Step("ok", "Prepared", None) if phase == "Created" else Step("panic", phase, None)
    if op == "resize":
        return Step("err" if phase in ("Created", "Failed") else "ok", phase, None)
    if op == "render_frame":
        if phase == "Created":
            return Step("panic", phase, None)
        if phase in ("Paused", "Failed"):
            return Step("err", phase, None)
        return Step("ok", "Rendering", "Cpu" if is_first_frame or not shown else "Unchanged")
    if op == "pause":
        return Step("noop", phase, None) if phase == "Failed" else Step("ok", "Paused", None)
    if op == "resume":
        return Step("ok", "Rendering", None) if phase == "Paused" else Step("noop", phase, None)
    return Step("noop", phase, None)


class Lifecycle(OrderedFold):
    """Outcomes, phases, surface sizes and rendered buffers, as ``operators.lifecycle.replay`` has them."""

    OUT = "key string, us long, event_id long, op string, phase_before string, outcome string, phase string, output string, width long, height long, bytes long, stride long, damage string"
    STATE = "phase string, shown boolean, sized boolean, width long, height long"
    EVENT = "op string, is_first_frame boolean, width long, height long"

    def start(self) -> tuple:
        return "Created", False, False, None, None

    def step(self, state: tuple, us: int, event_id: int, event: tuple) -> tuple[tuple, tuple]:
        phase, shown, sized, width, height = state
        op, first, new_width, new_height = event
        done = step(phase, shown, op, bool(first))
        if done.outcome == "ok" and op in ("prepare", "resize"):
            sized, width, height = True, new_width, new_height
        drawn = done.output == "Cpu"
        whole = drawn and sized and width is not None
        frame = (4 * width * height if whole and height is not None else None, 4 * width if whole else None, "Full" if drawn else None)
        row = (us, event_id, op, phase, *done, width, height, *frame)
        return (done.phase, shown or done.output is not None, sized, width, height), row


def replay_stream(events: DataFrame, key: str, late: str = "0 seconds") -> DataFrame:
    """A stream of ``events`` (key, ts, event_id, op, is_first_frame and, if they have sizes, width and height) -> outcomes, in
    append mode, in any order of arrival within ``late``. Events are answered once the watermark has passed them."""
    sizes = [c for c in ("width", "height") if c not in events.columns]
    of = events.withColumns({c: F.lit(None).cast("long") for c in sizes}) if sizes else events
    return folded(of.withColumns({c: F.col(c).cast("long") for c in ("width", "height")}), key, late, Lifecycle(), "op", "is_first_frame", "width", "height")
