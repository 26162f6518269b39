"""The frame loop: configure events and frame callbacks, animated for a fixed number of frames, then static."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Animated frames, and the colour ramp's starts and spans.
ANIMATED_FRAMES = 10
RAMP = {"r": (0.10, 0.05), "g": (0.15, 0.10), "b": (0.25, 0.15)}


def frame_loop(events: DataFrame, key: str, order: Sequence[str], limit: int = ANIMATED_FRAMES) -> DataFrame:
    """``events`` (key, order, kind: configure or callback, acquire_failed) with ``action`` (init, resize or
    callback; skip_acquire; idle), ``frames_before``, ``damage`` (Full or None), ``callback_requested`` and the
    colour r, g, b of rendered frames.

    Configuring always renders; a callback only while animated, that is for the first ``limit`` frames. A
    failed acquisition renders nothing, counts nothing and requests nothing. Only the first configure event
    initialises."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce("acquire_failed", F.lit(False))
    configure = F.col("kind") == "configure"
    total = lambda c: F.coalesce(F.sum(c.cast("long")).over(before), F.lit(0).cast("long"))
    out = events.withColumns({"__could": total(~failed), "__configured": total(configure)})
    # up to the limit every event that could render did; beyond it only configure events do
    rendered = ~failed & (configure | (F.col("__could") < limit))
    out = out.withColumn("__rendered", rendered).withColumn("frames_before", total(F.col("__rendered")))
    animated = F.col("frames_before") < limit
    first = F.col("frames_before") == 0
    action = (
        F.when(~configure & ~animated, "idle")
        .when(failed, "skip_acquire")
        .when(configure, F.when(F.col("__configured") == 0, "init").otherwise("resize"))
        .otherwise("callback")
    )
    t = F.col("frames_before") / F.lit(float(limit))
    shown = F.col("__rendered")
    return out.withColumns({
        "action": action,
        "damage": F.when(shown, F.when(first | animated, "Full").otherwise("None")),
        "callback_requested": shown & animated,
        **{c: F.when(shown, F.lit(start) + F.lit(span) * t) for c, (start, span) in RAMP.items()},
    }).drop("__could", "__configured", "__rendered")


def clamped(width: str, height: str) -> dict:
    """Sizes of at least one pixel, as a resize takes them."""
    return {width: F.greatest(F.col(width), F.lit(1)), height: F.greatest(F.col(height), F.lit(1))}


def buffer_faults(buffers: DataFrame) -> DataFrame:
    """``buffers`` (buffer: data, width, height, stride) with ``fault``: which invariant is broken, else null."""
    b = F.col("buffer")
    size = F.octet_length(b["data"]).cast("long")
    return buffers.withColumn("fault", F.when(size != b["width"] * b["height"] * 4, "length").when(b["stride"] != b["width"] * 4, "stride"))
