"""Event queries: users of ``events`` as keys, event types as operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import compat, frames, ipc, lifecycle, policy, present, ranges
from quillon.sources.tables import events, mock_frame_request, solid_buffer, table

ORDER = ("ts", "event_id")
OPS = {"signup": "prepare", "view": "render_frame", "click": "resize", "error": "pause", "purchase": "resume"}
TAGS = {"click": "Cpu", "view": "Unchanged", "purchase": "DeviceEncoded", "signup": "SkippedDegraded", "error": "Cpu"}
RAW = {"click": "ping", "view": " status ", "error": "quit\n", "purchase": "noise", "signup": ""}
CLI = {"click": "profile set", "view": "output list", "purchase": "status", "signup": "diag", "error": "statuses"}
SEGMENT = 16
RENDERS = {"signup": "prepare", "view": "render_begin", "click": "resize", "error": "pause", "purchase": "render_end"}
ERRORS = {0: "SurfaceLost", 1: "DeviceLost", 2: "Transient"}


def _mapped(names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda most: F.when(F.col("event_type").isin("signup", "click"), _k() % most + 1)
    return events(spark, sf_dir).select(
        "event_id", "user_id", "ts", _mapped(OPS).alias("op"), (_k() % 7 == 0).alias("is_first_frame"), size(400).alias("width"), size(300).alias("height")
    )


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.replay(_operations(spark, sf_dir), "user_id", ORDER)


def _outcomes(replayed: DataFrame) -> DataFrame:
    surface = [F.col(f"surface.{c}").alias(c) for c in ("width", "height")]
    frame = [F.col(f"frame.{c}").alias(c) for c in ("bytes", "stride", "damage")]
    return replayed.select("event_id", "phase_before", "outcome", "message", "phase", "output", *surface, *frame)


def lifecycle_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(_replayed(spark, sf_dir))


def lifecycle_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outcomes, every user's events replayed by ranges of time."""
    return _outcomes(ranges.replay(_operations(spark, sf_dir), "user_id", ORDER))


def call_trace_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's calls in segments of sixteen."""
    of = events(spark, sf_dir).select("event_id", "user_id", "ts", _mapped(OPS).alias("op"))
    return ranges.trace_segments(of, "user_id", ORDER, segment=SEGMENT).select("user_id", "segment", "first", F.array_join("calls", ",").alias("calls"))


def lifecycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.summary(_replayed(spark, sf_dir), "user_id", ORDER)


def call_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = events(spark, sf_dir).select("event_id", "user_id", "ts", _mapped(OPS).alias("op"))
    return lifecycle.call_trace(of, "user_id", ORDER).select("user_id", F.array_join("trace", ",").alias("trace"))


def pause_noop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, before = _replayed(spark, sf_dir), F.col("phase_before")
    return r.groupBy("user_id").agg(F.count_if((F.col("op") == "pause") & (before == "Paused")).alias("repeated_pauses"), F.count_if((F.col("op") == "resume") & (before != "Paused")).alias("idle_resumes"))


def frame_output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _replayed(spark, sf_dir).groupBy("user_id")
    shown = F.col("output") == "Cpu"
    return out.agg(F.count_if(shown).alias("cpu"), F.count_if(F.col("output") == "Unchanged").alias("unchanged"), F.min_by(F.when(shown, F.col("event_id")), F.when(shown, F.struct("ts", "event_id"))).alias("first_shown"))


def present_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.lit(None).cast("string")
    for k, e in ERRORS.items():
        error = F.when(_k() % 17 == k, e).otherwise(error)
    of = events(spark, sf_dir).select("event_id", "user_id", "ts", _mapped(TAGS).alias("frame_tag"), error.alias("inject_error"), (_k() % 5 == 0).alias("recreate"))
    out = present.present(of, "user_id", ORDER)
    return out.select("event_id", "result", "status", F.col("present_count").cast("long").alias("present_count"), F.col("recreate_count").cast("long").alias("recreate_count"))


def frame_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "click"), "configure").otherwise("callback")
    of = events(spark, sf_dir).select("event_id", "user_id", "ts", kind.alias("kind"), (F.col("event_type") == "error").alias("acquire_failed"))
    out = frames.frame_loop(of, "user_id", ORDER)
    return out.select("event_id", "action", "frames_before", "damage", "callback_requested", *[F.round(c, 4).alias(c) for c in "rgb"])


def ipc_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = events(spark, sf_dir).select("event_id", "user_id", "ts", _mapped(RAW).alias("raw"))
    return ipc.route(of, "user_id", ORDER).select("event_id", "command", F.col("handled").cast("long").alias("handled"), "reply")


def ipc_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb = _mapped({"click": "Ping", "view": "Pause", "purchase": "Shout"})
    raw = F.when(F.col("event_type") == "error", "{not json").otherwise(F.to_json(F.struct(verb.alias("cmd"), F.col("user_id").cast("string").alias("arg"))))
    return ipc.json_requests(events(spark, sf_dir).select("event_id", raw.alias("raw"))).select("event_id", "verb", "error")


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.recent(events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", ORDER).select("event_id", "user_id", F.col("age").cast("long").alias("age"))


def hotplug_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return policy.bursts(of, "user_id", "ts", seconds=259_200, least=3).select("event_id", "in_window", "burst")


def hotplug_burst_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the window and the count that the policy states: ten in thirty seconds. An hour's events are one output's."""
    of = events(spark, sf_dir).select("event_id", F.date_trunc("hour", "ts").alias("output"), "ts")
    return policy.bursts(of, "output", "ts").select("event_id", "in_window", "burst")


def deferred_present_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the timeout that the policy states, a tenth of a second: a scale comes 0 to 199 milliseconds later."""
    surfaces = events(spark, sf_dir).select("event_id", F.col("ts").alias("surface_ts"))
    scales = events(spark, sf_dir).where(_k().isNotNull()).select("event_id", F.timestamp_micros(F.unix_micros("ts") + (_k() % 200) * 1000).alias("scale_ts"))
    out = policy.deferred_present(surfaces, scales, "event_id")
    return out.select("event_id", F.unix_micros("surface_ts").alias("surface_us"), F.unix_micros("present_ts").alias("present_us"))


def surface_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _mapped({"signup": "PendingConfigure", "click": "Configured", "view": "Live", "purchase": "Live", "error": "Configured"})
    of = events(spark, sf_dir).select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), state.alias("state"), (_k() % 3 == 0).alias("has_buffer"))
    return policy.surface_order(of, "user_id", "at").select("event_id", "state", "fault")


def reentrancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that come while a frame is still being rendered, as the events before them tell."""
    of = events(spark, sf_dir).select("event_id", "user_id", "ts", _mapped(RENDERS).alias("op"))
    return lifecycle.reentrancy(of, "user_id", ORDER).select("event_id", "op", "in_render", "outcome")


def capability_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every user's frame source answers, and what its first prepare reports."""
    ready = lifecycle.load_report((F.col("op") == "prepare") & (F.col("outcome") == "ok"))
    of = _replayed(spark, sf_dir).withColumn("report", ready).where("report IS NOT NULL")
    said = [F.lit(v).alias(c) for c, v in lifecycle.CAPABILITIES.items()]
    return of.select("user_id", *said, F.col("report.status").alias("status"), F.col("report.stats.total_bytes").alias("total_bytes"), F.col("report.stats.image_count").cast("long").alias("image_count"))


def fullscreen_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = events(spark, sf_dir).select("event_id", (F.col("event_type") == "view").alias("fullscreen"), (_k() % 2 == 0).alias("fullscreen_detection"))
    return of.select("event_id", policy.pause_on_fullscreen().alias("pause"))


def cli_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(_mapped(CLI), F.when(_k() % 2 == 0, F.concat(F.lit(" "), F.col("user_id").cast("string"))).otherwise(F.lit("")))
    return events(spark, sf_dir).select("event_id", ipc.cli_verb(line).alias("verb"))


def date_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") != "P").alias("passed"), F.col("o_orderdate").cast("date").alias("done_on"))
    return policy.gate(checks, "o_custkey", "1997-06-01").select("o_custkey", "open")


def response_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("answered"))
    issues = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderdate").cast("timestamp").alias("opened"), F.col("answered").cast("timestamp").alias("answered"))
    return policy.response_gate(issues).select("median_days", "ok")


def mock_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mock frame source for every user, prepared when they sign up and rendered whenever they view, and what the
    mock renderer says to it."""
    asked = events(spark, sf_dir).where("event_type IN ('signup', 'view')").select("event_id", "user_id", "ts", _mapped(OPS).alias("op"), F.lit(False).alias("is_first_frame"))
    size = mock_frame_request(spark).select("width", "height").first()
    out = lifecycle.replay(asked.withColumns({"width": F.lit(size.width), "height": F.lit(size.height)}), "user_id", ORDER)
    return out.select("event_id", "op", "phase", "output", F.col("surface.width").alias("width"), F.col("surface.height").alias("height"), F.col("frame.bytes").alias("bytes"), compat.mock_negotiate().alias("negotiation"))


def deferred_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    surfaces = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("surface_ts"))
    scales = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("scale_ts"))
    out = policy.deferred_present(surfaces, scales, "user_id", millis=86_400_000)
    return out.select("user_id", F.unix_micros("surface_ts").alias("surface_us"), F.unix_micros("present_ts").alias("present_us"))


def last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = events(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type")
    return policy.last_state(of, "user_id", "at").select("user_id", "event_id", "event_type")


def solid_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size"), F.col("p_size") % 7 + 1
    made = table(spark, sf_dir, "part").select("p_partkey", solid_buffer(w, h, (38, 51, 77, 255)).alias("buffer"))
    b = F.col("buffer")
    return frames.buffer_faults(made).select("p_partkey", F.octet_length(b["data"]).cast("long").alias("n_bytes"), b["stride"].alias("stride"), F.hex(F.substring(b["data"], 1, 4)).alias("pixel"), "fault")


QUERIES = {f.__name__: f for f in (lifecycle_outcomes, lifecycle_by_range, lifecycle_status, call_traces, call_trace_segments, pause_noop_counts, frame_output_counts, present_recovery, frame_loop, ipc_router, ipc_json, recent_events, hotplug_burst, hotplug_burst_stated, deferred_present, deferred_present_stated, last_state, surface_order, reentrancy, capability_queries, fullscreen_pause, cli_verbs, date_gate, response_gate, mock_source)}
QUERIES["solid_buffer"] = solid_buffers


def _case(names: dict) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


# The automata again, as a fold: one step per event, not by windows.
_E = f"e AS (SELECT event_id, user_id, ts, event_type, {_case(OPS)} AS op, CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
_OK = """CASE e.op WHEN 'prepare' THEN CASE WHEN r.phase = 'Created' THEN 'ok' ELSE 'panic' END WHEN 'resize' THEN CASE WHEN r.phase IN ('Created', 'Failed') THEN 'err' ELSE 'ok' END
  WHEN 'render_frame' THEN CASE WHEN r.phase = 'Created' THEN 'panic' WHEN r.phase IN ('Paused', 'Failed') THEN 'err' ELSE 'ok' END
  WHEN 'pause' THEN CASE WHEN r.phase = 'Failed' THEN 'noop' ELSE 'ok' END WHEN 'resume' THEN CASE WHEN r.phase = 'Paused' THEN 'ok' ELSE 'noop' END ELSE 'noop' END"""
_FOLD = f"""RECURSIVE {_E}, r AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, 'Created' AS phase, 'Created' AS phase_before, '' AS outcome, '' AS op, false AS shown, CAST(NULL AS VARCHAR) AS output, CAST(NULL AS BIGINT) AS width, CAST(NULL AS BIGINT) AS height FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN o = 'ok' AND op = 'prepare' THEN 'Prepared' WHEN o = 'ok' AND op IN ('render_frame', 'resume') THEN 'Rendering' WHEN o = 'ok' AND op = 'pause' THEN 'Paused' ELSE p END, p, o, op,
    s OR (o = 'ok' AND op = 'render_frame'), CASE WHEN o = 'ok' AND op = 'render_frame' THEN CASE WHEN s AND NOT first THEN 'Unchanged' ELSE 'Cpu' END END,
    CASE WHEN o = 'ok' AND op IN ('prepare', 'resize') THEN k % 400 + 1 ELSE w END, CASE WHEN o = 'ok' AND op IN ('prepare', 'resize') THEN k % 300 + 1 ELSE h END
  FROM (SELECT e.user_id, e.rn, e.event_id, e.op, e.k, coalesce(e.k % 7 = 0, false) AS first, r.phase AS p, r.shown AS s, r.width AS w, r.height AS h, {_OK} AS o FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)),
l AS (SELECT * FROM r WHERE rn > 0)"""
_STATUS = "CASE WHEN phase IN ('Paused', 'Failed') THEN phase ELSE 'Ready' END"
_TRIMMED = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
ORACLES = {
    "lifecycle_outcomes": f"""WITH {_FOLD} SELECT event_id, phase_before, outcome, CASE WHEN outcome = 'panic' AND op = 'prepare' THEN 'prepare called in phase ' || phase_before || ', expected Created'
      WHEN outcome = 'panic' THEN 'render_frame called before prepare' WHEN outcome = 'err' AND op = 'resize' THEN 'resize before prepare' WHEN outcome = 'err' THEN 'render_frame while paused' END AS message, phase, output, width, height,
      CASE WHEN output = 'Cpu' THEN 4 * width * height END AS bytes, CASE WHEN output = 'Cpu' THEN 4 * width END AS stride, CASE WHEN output = 'Cpu' THEN 'Full' END AS damage FROM l""",
    "lifecycle_status": f"""WITH {_FOLD}, g AS (SELECT user_id, max_by(phase, rn) AS phase, count(*) AS events, count(*) FILTER (WHERE outcome IN ('err', 'panic')) AS rejected, count(*) FILTER (WHERE output = 'Cpu') AS frames_shown FROM l GROUP BY user_id)
      SELECT user_id, phase, {_STATUS} AS status, events, rejected, frames_shown FROM g""",
    "call_trace_segments": f"WITH {_E} SELECT user_id, (rn - 1) // {SEGMENT} AS segment, (rn - 1) // {SEGMENT} * {SEGMENT} AS first, string_agg(op, ',' ORDER BY rn) AS calls FROM e GROUP BY user_id, (rn - 1) // {SEGMENT}",
    "call_traces": f"WITH {_E} SELECT user_id, string_agg(op, ',' ORDER BY rn) AS trace FROM e GROUP BY user_id",
    "pause_noop_counts": f"WITH {_FOLD} SELECT user_id, count(*) FILTER (WHERE op = 'pause' AND phase_before = 'Paused') AS repeated_pauses, count(*) FILTER (WHERE op = 'resume' AND phase_before <> 'Paused') AS idle_resumes FROM l GROUP BY user_id",
    "frame_output_counts": f"WITH {_FOLD} SELECT user_id, count(*) FILTER (WHERE output = 'Cpu') AS cpu, count(*) FILTER (WHERE output = 'Unchanged') AS unchanged, min_by(event_id, rn) FILTER (WHERE output = 'Cpu') AS first_shown FROM l GROUP BY user_id",
    "present_recovery": f"""WITH RECURSIVE {_E}, r AS (
      SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS result, 'Ready' AS status, CAST(0 AS BIGINT) AS present_count, CAST(0 AS BIGINT) AS recreate_count FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, rn, event_id, x, CASE WHEN x IN ('SurfaceLost', 'DeviceLost') THEN x WHEN again THEN 'Ready' ELSE status END, present_count + CASE WHEN x = 'Presented' THEN 1 ELSE 0 END, recreate_count + CASE WHEN again THEN 1 ELSE 0 END
      FROM (SELECT e.user_id, e.rn, e.event_id, r.status, r.present_count, r.recreate_count, coalesce(e.k % 5 = 0, false) AS again,
        CASE e.k % 17 WHEN 0 THEN 'SurfaceLost' WHEN 1 THEN 'DeviceLost' WHEN 2 THEN 'Transient' ELSE CASE WHEN e.event_type IN ('click', 'purchase', 'error') THEN 'Presented' ELSE 'Skipped' END END AS x
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
      SELECT event_id, result, status, present_count, recreate_count FROM r WHERE rn > 0""",
    "frame_loop": f"""WITH RECURSIVE {_E}, r AS (
      SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS frames, CAST(0 AS BIGINT) AS frames_before, CAST(0 AS BIGINT) AS configured, CAST(NULL AS VARCHAR) AS action, false AS drawn FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, rn, event_id, frames + CASE WHEN a IN ('init', 'resize', 'callback') THEN 1 ELSE 0 END, frames, configured + CASE WHEN c THEN 1 ELSE 0 END, a, a IN ('init', 'resize', 'callback')
      FROM (SELECT e.user_id, e.rn, e.event_id, r.frames, r.configured, e.event_type IN ('signup', 'click') AS c,
        CASE WHEN e.event_type NOT IN ('signup', 'click') AND r.frames >= 10 THEN 'idle' WHEN e.event_type = 'error' THEN 'skip_acquire' WHEN e.event_type IN ('signup', 'click') THEN CASE WHEN r.configured = 0 THEN 'init' ELSE 'resize' END ELSE 'callback' END AS a
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
      SELECT event_id, action, frames_before, CASE WHEN drawn THEN CASE WHEN frames_before < 10 THEN 'Full' ELSE 'None' END END AS damage, drawn AND frames_before < 10 AS callback_requested,
        CASE WHEN drawn THEN round(0.1 + 0.05 * (frames_before / 10.0), 4) END AS r, CASE WHEN drawn THEN round(0.15 + 0.1 * (frames_before / 10.0), 4) END AS g, CASE WHEN drawn THEN round(0.25 + 0.15 * (frames_before / 10.0), 4) END AS b
      FROM r WHERE rn > 0""",
    "ipc_router": f"""WITH a AS (SELECT event_id, user_id, ts, {_case(RAW)} AS raw FROM events), b AS (SELECT event_id, user_id, ts, {_TRIMMED} AS command FROM a WHERE length(raw) > 0),
      q AS (SELECT user_id, min((ts, event_id)) AS stop FROM b WHERE command = 'quit' GROUP BY user_id),
      h AS (SELECT event_id, command, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS handled FROM b LEFT JOIN q USING (user_id) WHERE stop IS NULL OR (ts, event_id) <= stop)
      SELECT event_id, command, handled, CASE command WHEN 'ping' THEN 'pong' || chr(10) WHEN 'status' THEN 'frames=0 animate=true ipc_commands=' || handled || chr(10) WHEN 'quit' THEN 'bye' || chr(10) ELSE 'error: unknown command ''' || command || '''' || chr(10) END AS reply FROM h""",
    "ipc_json": """SELECT event_id, CASE event_type WHEN 'click' THEN 'Ping' WHEN 'view' THEN 'Pause' END AS verb,
      CASE event_type WHEN 'purchase' THEN 'unknown request Shout' WHEN 'error' THEN 'malformed request' WHEN 'signup' THEN 'malformed request' END AS error FROM events""",
    "recent_events": "SELECT event_id, user_id, age FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 100",
    "hotplug_burst": "SELECT a.event_id, count(*) AS in_window, count(*) >= 3 AS burst FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 259200 SECOND GROUP BY a.event_id",
    "hotplug_burst_stated": """WITH o AS (SELECT event_id, ts, date_trunc('hour', ts) AS output FROM events)
      SELECT event_id, count(*) OVER (PARTITION BY output ORDER BY ts RANGE BETWEEN INTERVAL 30 SECOND PRECEDING AND CURRENT ROW) AS in_window,
      count(*) OVER (PARTITION BY output ORDER BY ts RANGE BETWEEN INTERVAL 30 SECOND PRECEDING AND CURRENT ROW) >= 10 AS burst FROM o""",
    "deferred_present_stated": f"WITH {_E} SELECT event_id, epoch_us(ts) AS surface_us, epoch_us(ts) + 1000 * least(100, coalesce(k % 200, 100)) AS present_us FROM e",
    "surface_order": f"""WITH {_E}, s AS (SELECT event_id, user_id, rn, {_case({"signup": "PendingConfigure", "click": "Configured", "view": "Live", "purchase": "Live", "error": "Configured"})} AS state,
        CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 2 ELSE 3 END AS place, coalesce(k % 3 = 0, false) AS has_buffer FROM e),
      t AS (SELECT s.*, p.place AS before FROM s LEFT JOIN s p ON p.user_id = s.user_id AND p.rn = s.rn - 1)
      SELECT event_id, state, CASE WHEN before IS NULL AND has_buffer THEN 'buffer in initial commit' WHEN place = coalesce(before, 0) + 1 OR (place = 3 AND before = 3) THEN NULL ELSE 'out of order' END AS fault FROM t""",
    "reentrancy": f"""WITH RECURSIVE {_E}, m AS (SELECT user_id, rn, event_id, {_case(RENDERS)} AS op FROM e), r AS (
      SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, '' AS op, false AS before, false AS open FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT m.user_id, m.rn, m.event_id, m.op, r.open, CASE m.op WHEN 'render_begin' THEN true WHEN 'render_end' THEN false ELSE r.open END FROM r JOIN m ON m.user_id = r.user_id AND m.rn = r.rn + 1)
      SELECT event_id, op, before AS in_render, CASE WHEN before AND op IN ('resize', 'render_begin') THEN 'panic' END AS outcome FROM r WHERE rn > 0""",
    "capability_queries": f"WITH {_FOLD} SELECT DISTINCT user_id, 'Static' AS source_kind, 'Immediate' AS resize, 'Freeze' AS pause_semantics, 'Photo' AS content_type_hint, 'Ok' AS status, CAST(1024 AS BIGINT) AS total_bytes, CAST(1 AS BIGINT) AS image_count FROM l WHERE op = 'prepare' AND outcome = 'ok'",
    "fullscreen_pause": f"WITH {_E} SELECT event_id, coalesce(event_type = 'view' AND k % 2 = 0, false) AS pause FROM e",
    "cli_verbs": "SELECT event_id, CASE event_type WHEN 'click' THEN 'SetProfile' WHEN 'view' THEN 'GetOutputs' WHEN 'purchase' THEN 'GetActiveProfile' WHEN 'signup' THEN 'Diag' END AS verb FROM events",
    "date_gate": "SELECT o_custkey, bool_and(coalesce(o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) <= DATE '1997-06-01', false)) AS open FROM orders GROUP BY o_custkey",
    "response_gate": """WITH f AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(min(l_shipdate) AS DATE)) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate)
      SELECT CAST(median(days) AS DOUBLE) AS median_days, median(days) < 14 AS ok FROM f""",
    "mock_source": """WITH a AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('signup', 'view')),
      p AS (SELECT user_id, min(rn) AS ready FROM a WHERE event_type = 'signup' GROUP BY user_id),
      b AS (SELECT a.*, coalesce(rn >= ready, false) AS made, row_number() OVER (PARTITION BY a.user_id, event_type, coalesce(rn >= ready, false) ORDER BY rn) AS nth,
        count(*) FILTER (WHERE event_type = 'view' AND rn >= ready) OVER (PARTITION BY a.user_id ORDER BY rn) AS seen FROM a LEFT JOIN p ON p.user_id = a.user_id)
      SELECT event_id, CASE event_type WHEN 'signup' THEN 'prepare' ELSE 'render_frame' END AS op, CASE WHEN NOT made THEN 'Created' WHEN seen > 0 THEN 'Rendering' ELSE 'Prepared' END AS phase,
        CASE WHEN made AND event_type = 'view' THEN CASE WHEN nth = 1 THEN 'Cpu' ELSE 'Unchanged' END END AS output, CASE WHEN made THEN CAST(1920 AS BIGINT) END AS width, CASE WHEN made THEN CAST(1080 AS BIGINT) END AS height,
        CASE WHEN made AND event_type = 'view' AND nth = 1 THEN CAST(8294400 AS BIGINT) END AS bytes, 'Compatible' AS negotiation FROM b""",
    "deferred_present": """WITH s AS (SELECT user_id, epoch_us(min(ts)) AS surface_us FROM events WHERE event_type = 'view' GROUP BY user_id)
      SELECT s.user_id, surface_us, least(surface_us + 86400000000, coalesce(min(epoch_us(e.ts)), surface_us + 86400000000)) AS present_us
      FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = 'click' AND epoch_us(e.ts) >= surface_us GROUP BY s.user_id, surface_us""",
    "last_state": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "solid_buffer": "SELECT p_partkey, CAST(4 AS BIGINT) * p_size * (p_size % 7 + 1) AS n_bytes, CAST(4 AS BIGINT) * p_size AS stride, '26334DFF' AS pixel, CAST(NULL AS VARCHAR) AS fault FROM part",
}
ORACLES["lifecycle_by_range"] = ORACLES["lifecycle_outcomes"]
