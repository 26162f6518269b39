"""The lifecycle automaton of a frame source, replayed over ordered events per key.

The automaton's memory is a few running extremes (last pause, last resume, first prepare, last render), so
a window computes every event's phase in one sort per key, streaming, with no list of events held. Rejected
operations are outcomes, not exceptions: they leave the phase as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a capability query answers, what prepare reports, the colour of a rendered buffer, and the
#: texts of rejections.
CAPABILITIES = {"source_kind": "Static", "resize": "Immediate", "pause_semantics": "Freeze", "content_type_hint": "Photo"}
LOADED_BYTES, LOADED_IMAGES = 1024, 1
COLOUR = (38, 51, 77, 255)
PREPARED_TWICE, RENDER_EARLY, RESIZE_EARLY, RESIZE_FAILED = "prepare called in phase {}, expected Created", "render_frame called before prepare", "resize before prepare", "resize after failure"
RENDER_PAUSED, RENDER_FAILED = "render_frame while paused", "render_frame after failure"


def replay(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``events`` (key, order, op, is_first_frame and, if they have sizes, width and height) with ``phase_before``,
    ``phase`` (after), ``status``, ``outcome`` (ok, err, panic or noop), ``message`` and ``output`` (Cpu or Unchanged,
    of successful renders).

    With sizes, ``surface`` is the size that the last successful prepare or resize set, and ``frame`` describes
    the buffer of a Cpu output: bytes, stride and damage, which is always whole. Unknown and null operations are
    noops. A null is_first_frame is false. A key's events are replayed by one task, in constant memory; ``ranges.replay``
    deals those of one key over many."""
    sized = {"width", "height"} <= set(events.columns)
    seen = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    of = lambda op: F.when(F.col("op") == op, F.col("__at"))
    out = events.withColumn("__at", at).withColumns({
        "__pause": F.max(of("pause")).over(seen), "__resume": F.max(of("resume")).over(seen),
        "__prepare": F.min(of("prepare")).over(seen), "__render": F.max(of("render_frame")).over(seen),
    })
    out = judged(out)
    shown = (F.col("op") == "render_frame") & (F.col("outcome") == "ok")
    out = with_output(out, F.coalesce(F.max(shown.cast("int")).over(seen), F.lit(0)) == 0)
    if sized:
        here = seen.rowsBetween(Window.unboundedPreceding, 0)
        out = with_frame(out, F.last(given_size(), ignorenulls=True).over(here))
    return out.drop("__at", "__pause", "__resume", "__prepare", "__render")


def judged(events: DataFrame) -> DataFrame:
    """``events`` (op, and the numbers of the last pause, resume and render and of the first prepare before) with phases,
    outcome, message and status."""
    # after any pause only pauses and resumes matter; before, a render counts once prepared
    before = (
        F.when(F.col("__pause") > F.coalesce("__resume", F.lit(0)), "Paused")
        .when(F.col("__pause").isNotNull(), "Rendering")
        .when(F.col("__render") > F.col("__prepare"), "Rendering")
        .when(F.col("__prepare").isNotNull(), "Prepared")
        .otherwise("Created")
    )
    out = events.withColumn("phase_before", before)
    p, op = F.col("phase_before"), F.col("op")
    out = out.withColumn("outcome", _outcome(p, op)).withColumn("message", _message(p, op, F.col("outcome")))
    return out.withColumn("phase", _after(p, op, F.col("outcome"))).withColumn("status", status_of(F.col("phase")))


def with_output(events: DataFrame, unseen: Column) -> DataFrame:
    """``events`` with ``output``; ``unseen`` says that no frame was rendered before."""
    shown = (F.col("op") == "render_frame") & (F.col("outcome") == "ok")
    first = F.coalesce("is_first_frame", F.lit(False)) | unseen
    return events.withColumn("output", F.when(shown, F.when(first, "Cpu").otherwise("Unchanged")))


def given_size() -> Column:
    """The size that an event sets, else null."""
    size = F.struct(F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    return F.when((F.col("outcome") == "ok") & F.col("op").isin("prepare", "resize"), size)


def with_frame(events: DataFrame, surface: Column) -> DataFrame:
    """``events`` with ``surface`` and a rendered buffer's ``frame``."""
    out, w, h = events.withColumn("surface", surface), F.col("surface.width"), F.col("surface.height")
    return out.withColumn("frame", F.when(F.col("output") == "Cpu", F.struct((4 * w * h).alias("bytes"), (4 * w).alias("stride"), F.lit("Full").alias("damage"))))


def _outcome(p: Column, op: Column) -> Column:
    return (
        F.when(op == "prepare", F.when(p == "Created", "ok").otherwise("panic"))
        .when(op == "resize", F.when(p.isin("Created", "Failed"), "err").otherwise("ok"))
        .when(op == "render_frame", F.when(p == "Created", "panic").when(p.isin("Paused", "Failed"), "err").otherwise("ok"))
        .when(op == "pause", F.when(p == "Failed", "noop").otherwise("ok"))
        .when(op == "resume", F.when(p == "Paused", "ok").otherwise("noop"))
        .otherwise("noop")
    )


def _message(p: Column, op: Column, outcome: Column) -> Column:
    return (
        F.when((outcome == "panic") & (op == "prepare"), F.replace(F.lit(PREPARED_TWICE), F.lit("{}"), p))
        .when(outcome == "panic", F.lit(RENDER_EARLY))
        .when((outcome == "err") & (op == "resize"), F.when(p == "Created", RESIZE_EARLY).otherwise(RESIZE_FAILED))
        .when(outcome == "err", F.when(p == "Paused", RENDER_PAUSED).otherwise(RENDER_FAILED))
    )


def _after(p: Column, op: Column, outcome: Column) -> Column:
    done = outcome == "ok"
    return F.when(done & (op == "prepare"), "Prepared").when(done & op.isin("render_frame", "resume"), "Rendering").when(done & (op == "pause"), "Paused").otherwise(p)


def status_of(phase: Column) -> Column:
    return F.when(phase.isin("Paused", "Failed"), phase).otherwise("Ready")


def load_report(prepared: Column) -> Column:
    """What a successful prepare reports, else null."""
    none = F.array().cast("array<string>")
    stats = F.struct(F.lit(LOADED_BYTES).cast("long").alias("total_bytes"), F.lit(LOADED_IMAGES).alias("image_count"))
    return F.when(prepared, F.struct(F.lit("Ok").alias("status"), none.alias("warnings"), none.alias("ignored"), stats.alias("stats")))


def call_trace(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, trace): the names of all calls in order, rejected ones included. A trace is one value: for keys
    whose history fits in a row; ``ranges.trace_segments`` has no such bound."""
    calls = F.sort_array(F.collect_list(F.struct(*order, "op")))
    return events.groupBy(key).agg(F.transform(calls, lambda x: x["op"]).alias("trace"))


def summary(replayed: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, phase, status, events, rejected, frames_shown): each key's last state and counters."""
    last = F.max_by("phase", F.struct(*order))
    return replayed.groupBy(key).agg(
        last.alias("phase"), status_of(last).alias("status"), F.count("*").alias("events"),
        F.count_if(F.col("outcome").isin("err", "panic")).alias("rejected"), F.count_if(F.col("output") == "Cpu").alias("frames_shown"),
    )


def reentrancy(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``events`` (key, order, op) with ``in_render``, whether a render that began before has not ended yet, and ``outcome``:
    resizing then, or beginning another render, is a violation. Renders begin and end by the operations render_begin
    and render_end; one without the other is open to the end, or has no effect."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.when(F.col("op").isin("render_begin", "render_end"), F.col("op") == "render_begin")
    out = events.withColumn("in_render", F.coalesce(F.last(edge, ignorenulls=True).over(before), F.lit(False)))
    return out.withColumn("outcome", F.when(F.col("in_render") & F.col("op").isin("resize", "render_begin"), "panic"))
