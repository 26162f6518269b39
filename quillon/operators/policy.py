"""Policies that exist as descriptions only: assignment, degradation, fallback, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import ranges

#: Protocols that have to be there, and those that may be.
REQUIRED, OPTIONAL = ("LayerShell", "XdgOutput"), ("FractionalScale", "Viewporter", "ContentType", "ForeignToplevelList")
FITS = ("cover", "contain", "stretch", "tile", "center")
#: What happens to an asset, by category.
FALLBACKS = (
    ("format_unsupported", "error", None, None), ("image_small", "upscale", "W001", "Cosmetic"), ("exif_broken", "ignore_exif", "W002", "Cosmetic"),
    ("video_codec_unsupported", "error", None, None), ("video_resolution_huge", "downscale", "W010", "Cosmetic"),
)
#: How errors are handled.
RECOVERY = (("LoadError", "solid_colour"), ("InvalidState", "backend_failed"), ("SurfaceLost", "recreate_surface_once"), ("DeviceLost", "recreate_runtime"))


def assign(profiles: DataFrame, activations: DataFrame) -> DataFrame:
    """Assignments (profile, output, path, backend, fit) of the profile activated last.

    ``profiles``: name, outputs (map of output to struct of path, backend, fit); ``activations``: name, seq."""
    active = activations.groupBy().agg(F.max_by("name", "seq").alias("name"))
    return profiles.join(active, "name", "left_semi").select(F.col("name").alias("profile"), F.explode("outputs").alias("output", "__a")).select("profile", "output", "__a.*")


def degradation(protocols: DataFrame, key: str) -> DataFrame:
    """``protocols`` (key, protocol) -> a row per key: usable, scaling, content_hint, fullscreen_detection, warnings."""
    has = F.collect_set("protocol")
    out = protocols.groupBy(key).agg(F.filter(has, lambda p: p.isin(*REQUIRED, *OPTIONAL)).alias("has"))
    there = lambda p: F.array_contains("has", p)
    fractional = there("FractionalScale")
    warnings = F.array_compact(F.array(F.when(~fractional, F.lit("W023")), F.when(fractional & ~there("Viewporter"), F.lit("W024")), F.when(~there("ForeignToplevelList"), F.lit("W040"))))
    usable = there(REQUIRED[0]) & there(REQUIRED[1])
    return out.select(
        key, usable.alias("usable"), F.when(fractional & there("Viewporter"), "fractional").otherwise("integer").alias("scaling"),
        F.when(there("ContentType"), "photo").alias("content_hint"), there("ForeignToplevelList").alias("fullscreen_detection"), F.array_join(warnings, ",").alias("warnings"),
    )


def fallback_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FALLBACKS), "category string, action string, warning string, severity string")


def recovery_of(error: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, action in RECOVERY:
        out = F.when(error == name, action).otherwise(out)
    return out


def recent(events: DataFrame, key: str, order: Sequence[str], n: int = 100) -> DataFrame:
    """The last ``n`` events of each key, ``age`` from 1; ranks are limited before the shuffle."""
    out = events.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])))
    return out.where(F.col("age") <= n)


def bursts(events: DataFrame, key: str, ts: str, seconds: int = 30, least: int = 10) -> DataFrame:
    """``events`` with ``in_window`` (events of the key in the ``seconds`` up to this one) and ``burst``."""
    span = Window.partitionBy(key).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(span)).withColumn("burst", F.col("in_window") >= least)


def deferred_present(surfaces: DataFrame, scales: DataFrame, key: str, millis: int = 100) -> DataFrame:
    """``surfaces`` (key, surface_ts) with ``present_ts``: at the first scale event from then on, or ``millis`` later.

    One sort of surfaces and scales by key, no pairs of them. Surfaces of null keys have no scales."""
    both = surfaces.select(key, F.col("surface_ts").alias("at"), F.lit(None).cast("timestamp").alias("scale_ts"), F.lit(True).alias("surface"))
    both = both.unionByName(scales.select(key, F.col("scale_ts").alias("at"), "scale_ts", F.lit(False).alias("surface")))
    # from the latest on: the least scale so far is the next one, those of the same time included
    next_ = F.min("scale_ts").over(Window.partitionBy(key).orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    first = both.withColumn("scale_ts", next_).where("surface").select(key, F.col("at").alias("surface_ts"), "scale_ts").distinct()
    limit = F.timestamp_micros(F.unix_micros("surface_ts") + millis * 1000)
    return first.withColumn("present_ts", F.least(F.coalesce("scale_ts", limit), limit))


def regressions(series: DataFrame, key: str, order: str, value: str, limit: float = 0.10) -> DataFrame:
    """``series`` with ``previous``, ``change`` and ``blocked`` (worse than before by more than the limit)."""
    out = series.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(order)))
    out = out.withColumn("change", (F.col(value) - F.col("previous")) / F.col("previous"))
    return out.withColumn("blocked", F.coalesce(F.col("change") > limit, F.lit(False)))


def gate(checks: DataFrame, key: str, due: str) -> DataFrame:
    """``checks`` (key, passed, done_on) -> (key, open): all passed by the date."""
    return checks.groupBy(key).agg(F.bool_and(F.coalesce(F.col("passed") & (F.col("done_on") <= F.lit(due).cast("date")), F.lit(False))).alias("open"))


def pause_on_fullscreen() -> Column:
    """Whether to pause, of columns fullscreen and fullscreen_detection: both have to hold."""
    return F.coalesce(F.col("fullscreen") & F.col("fullscreen_detection"), F.lit(False))


def last_state(snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """The latest snapshot of each key."""
    cols = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("s")).select(key, "s.*")


def surface_order(events: DataFrame, key: str, order: str) -> DataFrame:
    """``events`` (key, order, state, has_buffer) with ``fault``: PendingConfigure, Configured, Live have to follow
    each other, and the first commit carries no buffer."""
    states = F.lit(["PendingConfigure", "Configured", "Live"])
    at = F.array_position(states, F.col("state"))
    before = F.coalesce(F.lag(at).over(Window.partitionBy(key).orderBy(order)), F.lit(0))
    first = before == 0
    return events.withColumn("fault", F.when(first & F.coalesce("has_buffer", F.lit(False)), "buffer in initial commit").when(~((at == before + 1) | ((at == before) & (at == 3))), "out of order"))


def response_gate(issues: DataFrame, days: int = 14) -> DataFrame:
    """(median_days, ok): the exact median time to the first response, from (opened, answered); null without one.

    Selected by counting over ranges (``ranges.select``), which takes a few jobs when the plan is built: no task
    ever holds the distinct times."""
    taken = issues.select((F.unix_micros("answered") - F.unix_micros("opened")).alias("us")).where("us IS NOT NULL")
    n, per_day = taken.count(), F.lit(86_400_000_000.0)
    middle = [F.lit(us).cast("long") / per_day for us in ranges.select(taken, ranges.quantile_places(n))] if n else []
    median = (middle[0] + (middle[1] - middle[0]) * 0.5) if middle else F.lit(None).cast("double")
    out = issues.sparkSession.range(1).select(median.alias("median_days"))
    return out.withColumn("ok", F.col("median_days") < days)
