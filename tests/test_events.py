"""Automata: contract cases, and random histories against the step function of the stream."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import error_text
from quillon.operators import frames, ipc, lifecycle, present
from quillon.sources.tables import LIFECYCLE_EVENT, PRESENT_EVENT, mock_frame_request, solid_buffer
from quillon.streaming.lifecycle import step


def run(spark, ops, first=()):
    rows = [("x", k, op, k in first, 1920, 1080, 1.0) for k, op in enumerate(ops)]
    return lifecycle.replay(spark.createDataFrame(rows, LIFECYCLE_EVENT), "case_id", ["seq"]).orderBy("seq").collect()


CASES = [
    (["render_frame"], ["panic"], "Created"),
    (["resize"], ["err"], "Created"),
    (["prepare", "render_frame", "resize"], ["ok", "ok", "ok"], "Rendering"),
    (["prepare", "prepare"], ["ok", "panic"], "Prepared"),
    (["prepare", "pause", "pause"], ["ok", "ok", "ok"], "Paused"),
    (["prepare", "pause", "resume", "resume"], ["ok", "ok", "ok", "noop"], "Rendering"),
    (["prepare"] + ["pause", "resume"] * 10, ["ok"] * 21, "Rendering"),
    (["prepare", "resume"], ["ok", "noop"], "Prepared"),
    (["pause", "resume", "render_frame"], ["ok", "ok", "ok"], "Rendering"),
    (["prepare", "pause", "render_frame"], ["ok", "ok", "err"], "Paused"),
    (["prepare", None, "dance"], ["ok", "noop", "noop"], "Prepared"),
]


@pytest.mark.parametrize(("ops", "outcomes", "phase"), CASES)
def test_lifecycle(spark, ops, outcomes, phase):
    got = run(spark, ops)
    assert [r.outcome for r in got] == outcomes and got[-1].phase == phase
    assert got[-1].status == ("Paused" if phase == "Paused" else "Ready")


def test_frames_of_the_lifecycle(spark):
    assert [r.output for r in run(spark, ["prepare", "render_frame", "render_frame"])] == [None, "Cpu", "Unchanged"]
    assert [r.output for r in run(spark, ["prepare", "render_frame", "resize", "render_frame"])][-1] == "Unchanged"
    assert [r.output for r in run(spark, ["prepare", "render_frame", "render_frame"], first={2})][-1] == "Cpu"
    assert run(spark, ["resize"])[0].message == "resize before prepare" and run(spark, ["prepare", "prepare"])[1].message == "prepare called in phase Prepared, expected Created"


def test_traces_hold_rejected_calls(spark):
    rows = [("x", k, op, False, 1, 1, 1.0) for k, op in enumerate(["render_frame", "prepare", "prepare"])]
    assert lifecycle.call_trace(spark.createDataFrame(rows, LIFECYCLE_EVENT), "case_id", ["seq"]).first().trace == ["render_frame", "prepare", "prepare"]


def test_random_histories_agree_with_the_step_function(spark):
    rng, rows, expected = random.Random(3), [], {}
    for case in range(60):
        phase, shown = "Created", False
        for k in range(rng.randint(1, 25)):
            op, first = rng.choice(["prepare", "resize", "render_frame", "pause", "resume", None]), rng.random() < 0.2
            rows.append((str(case), k, op, first, 1, 1, 1.0))
            done = step(phase, shown, op, first)
            expected[str(case), k] = (phase, *done)
            phase, shown = done.phase, shown or done.output is not None
    got = lifecycle.replay(spark.createDataFrame(rows, LIFECYCLE_EVENT), "case_id", ["seq"]).collect()
    assert {(r.case_id, r.seq): (r.phase_before, r.outcome, r.phase, r.output) for r in got} == expected


def test_reports_and_mock(spark):
    made = lifecycle.replay(mock_frame_request(spark), "case_id", ["seq"]).withColumn("report", lifecycle.load_report(F.col("outcome") == "ok")).first()
    assert made.report.status == "Ok" and made.report.stats.total_bytes == 1024 and (made.width, made.height) == (1920, 1080)


def test_calls_within_a_render(spark):
    ops = ["resize", "render_end", "render_begin", "pause", "resize", "render_begin", "resize", "render_end", "resize", None, "render_begin", None, "resize"]
    of = spark.createDataFrame([("x", k, op) for k, op in enumerate(ops)], "case_id string, seq long, op string")
    got = lifecycle.reentrancy(of, "case_id", ["seq"]).orderBy("seq").collect()
    assert [r.seq for r in got if r.outcome == "panic"] == [4, 5, 6, 12] and [r.seq for r in got if r.in_render] == [3, 4, 5, 6, 7, 11, 12]


def shown(spark, rows):
    df = spark.createDataFrame([("x", k, *r) for k, r in enumerate(rows)], PRESENT_EVENT)
    return [(r.result, r.status, r.present_count, r.recreate_count) for r in present.present(df, "case_id", ["seq"]).orderBy("seq").collect()]


def test_present(spark):
    assert shown(spark, [("Cpu", "SurfaceLost", False), (None, None, True), ("Cpu", None, False)]) == [("SurfaceLost", "SurfaceLost", 0, 0), (None, "Ready", 0, 1), ("Presented", "Ready", 1, 1)]
    assert shown(spark, [("Cpu", "DeviceLost", False)]) == [("DeviceLost", "DeviceLost", 0, 0)]
    assert shown(spark, [("Cpu", None, False), ("Cpu", "Transient", False), ("DeviceEncoded", None, None)]) == [("Presented", "Ready", 1, 0), ("Transient", "Ready", 1, 0), ("Presented", "Ready", 2, 0)]
    assert shown(spark, [("Unchanged", None, False), ("SkippedDegraded", None, False)]) == [("Skipped", "Ready", 0, 0)] * 2


def test_armed_errors_are_consumed_once_and_success_keeps_the_status(spark):
    got = shown(spark, [(None, "Transient", False), (None, "SurfaceLost", False), ("Cpu", None, False), ("Cpu", None, False)])
    assert got == [(None, "Ready", 0, 0), (None, "Ready", 0, 0), ("SurfaceLost", "SurfaceLost", 0, 0), ("Presented", "SurfaceLost", 1, 0)]


def loop(spark, events):
    df = spark.createDataFrame([("x", k, kind, failed) for k, (kind, failed) in enumerate(events)], "key string, seq long, kind string, acquire_failed boolean")
    return frames.frame_loop(df, "key", ["seq"]).orderBy("seq").collect()


def test_frame_loop_matches_a_plain_loop(spark):
    rng = random.Random(4)
    for _ in range(6):
        events = [("configure", False)] + [(rng.choice(["configure", "callback", "callback"]), rng.random() < 0.2) for _ in range(40)]
        n, configured, want = 0, 0, []
        for kind, failed in events:
            action = "idle" if kind == "callback" and n >= 10 else "skip_acquire" if failed else kind if kind == "callback" else "resize" if configured else "init"
            drawn = action in ("init", "resize", "callback")
            want.append((action, n, ("Full" if n < 10 else "None") if drawn else None, drawn and n < 10))
            n, configured = n + drawn, configured + (kind == "configure")
        assert [(r.action, r.frames_before, r.damage, r.callback_requested) for r in loop(spark, events)] == want


def test_colour_ramp_and_sizes(spark):
    got = loop(spark, [("configure", False), ("callback", None)])
    assert (got[0].r, got[0].g, got[0].b) == (0.10, 0.15, 0.25) and got[1].r == pytest.approx(0.105)
    sized = spark.createDataFrame([(0, 5)], "w int, h int").withColumns(frames.clamped("w", "h")).first()
    assert (sized.w, sized.h) == (1, 5)


def test_solid_buffers_and_their_faults(spark):
    made = spark.createDataFrame([(3, 2)], "w int, h int").select(solid_buffer(F.col("w"), F.col("h"), (38, 51, 77, 255)).alias("buffer"))
    b = frames.buffer_faults(made).first()
    assert b.fault is None and bytes(b.buffer.data) == bytes((38, 51, 77, 255)) * 6 and b.buffer.stride == 12
    broken = made.withColumn("buffer", F.col("buffer").withField("stride", F.lit(5).cast("long")))
    assert frames.buffer_faults(broken).first().fault == "stride"
    assert frames.buffer_faults(made.withColumn("buffer", F.col("buffer").withField("width", F.lit(9).cast("long")))).first().fault == "length"


def test_commands(spark):
    raw = ["", "ping\n", None, " status ", "what?", "quit", "ping"]
    df = spark.createDataFrame([("x", k, r) for k, r in enumerate(raw)], "key string, seq long, raw string")
    got = [(r.command, r.handled, r.reply) for r in ipc.route(df, "key", ["seq"]).orderBy("seq").collect()]
    assert got == [("ping", 1, "pong\n"), ("status", 2, "frames=0 animate=true ipc_commands=2\n"), ("what?", 3, "error: unknown command 'what?'\n"), ("quit", 4, "bye\n")]


def test_reads_are_bounded_and_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"p" * 300),), (bytearray(b"\xff\xfe"),), (bytearray(b"ok"),)], "d binary")
    assert [len(r.t) for r in df.select(ipc.decoded(F.col("d")).alias("t")).collect()] == [256, 0, 2]


def test_json_and_cli(spark):
    df = spark.createDataFrame([('{"cmd": "Ping"}',), ("{",), ('{"cmd": "Nope"}',), (None,)], "raw string")
    assert [(r.verb, r.error) for r in ipc.json_requests(df).collect()] == [("Ping", None), (None, "malformed request"), (None, "unknown request Nope"), (None, "malformed request")]
    lines = spark.createDataFrame([("profile set day",), ("diag",), ("profilex",)], "line string")
    assert [r.v for r in lines.select(ipc.cli_verb(F.col("line")).alias("v")).collect()] == ["SetProfile", "Diag", None]


def test_error_texts(spark):
    df = spark.createDataFrame([("Decoder", "bad"), ("ResourceExhausted", None), ("InvalidState", "x"), ("SurfaceLost", None), ("Other", None)], "c string, m string")
    assert [r.t for r in df.select(error_text(F.col("c"), F.col("m")).alias("t")).collect()] == ["decoder error: bad", "resource exhausted", "invalid state (bug): x", "surface lost", None]


def test_renderer_contract(spark):
    rows = [("a", 1, "Cpu", None, False), ("a", 2, "Cpu", "SurfaceLost", False), ("b", 1, "Unchanged", None, False), ("b", 2, "DeviceEncoded", None, True)]
    frames = spark.createDataFrame(rows, "case_id string, seq long, frame_tag string, inject_error string, recreate boolean")
    r: present.Renderer = present.TableRenderer()
    assert (r.surface_format, r.surface_size) == ("Bgra8Unorm", (1920, 1080))
    made = r.present(frames, "case_id", ["seq"])
    assert [x.result for x in made.orderBy("case_id", "seq").collect()] == ["Presented", "SurfaceLost", "Skipped", "Presented"]
    assert {(x.case_id, x.status, x.present_count) for x in r.status(made, "case_id", ["seq"]).collect()} == {("a", "SurfaceLost", 1), ("b", "Ready", 1)}
    said = [spark.range(1).select(x.negotiate(F.lit("DeviceEncoded")).alias("n")).first().n for x in (r, present.TableRenderer(mock=False))]
    assert said == ["Compatible", "CompatibleWithLimitations"]
