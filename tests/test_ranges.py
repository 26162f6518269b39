"""Long histories by ranges of time: the rows of the plain operators, dealt over many tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.catalog.events import OPS, _k, _mapped
from quillon.operators import lifecycle, ranges
from quillon.sources.tables import events
from tests.conftest import SF

ORDER = ["ts", "event_id"]
HISTORY = "event_id long, user_id long, ts timestamp, op string, is_first_frame boolean, width long, height long"


def history(spark, n, keys, seed=1):
    r, t = random.Random(seed), datetime(2024, 1, 1)
    ops = ["resize", "render_frame", "pause", "resume", None, "render_frame", "prepare"]
    rows = [(k, r.choice(keys), t + timedelta(seconds=r.randint(0, n // 3)), r.choice(ops), r.choice([True, False, False, None]), r.choice([None, 5, 640]), r.choice([3, 480])) for k in range(n)]
    return spark.createDataFrame(rows, HISTORY)


@pytest.mark.parametrize(("n", "keys", "n_ranges"), [(600, [1, 2, None], 8), (300, [7], 40), (5, [1], 64), (40, list(range(40)), 3)])
def test_replay_by_ranges_equals_replay(spark, n, keys, n_ranges):
    of = history(spark, n, keys)
    plain, by_range = lifecycle.replay(of, "user_id", ORDER), ranges.replay(of, "user_id", ORDER, n_ranges)
    assert set(plain.columns) == set(by_range.columns) and by_range.count() == n
    assert by_range.select(*plain.columns).exceptAll(plain).count() == 0


def test_without_sizes_and_without_events(spark):
    of = events(spark, SF).select("event_id", "user_id", "ts", _mapped(OPS).alias("op"), (_k() % 7 == 0).alias("is_first_frame"))
    plain, by_range = lifecycle.replay(of, "user_id", ORDER), ranges.replay(of, "user_id", ORDER)
    assert by_range.select(*plain.columns).exceptAll(plain).count() == 0 and by_range.count() == plain.count()
    assert ranges.replay(of.limit(0), "user_id", ORDER).count() == 0 and ranges.trace_segments(of.limit(0), "user_id", ORDER).count() == 0


def long_history(spark, n):
    """One key, whose state changes rarely enough that ranges depend on those before."""
    x = F.pmod(F.xxhash64("id"), F.lit(1_000))
    op = F.when(F.col("id") == 3, "prepare").when(x == 0, "pause").when(x == 1, "resume").when(x < 20, "resize").otherwise("render_frame")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") / 10)
    return spark.range(0, n, 1, 16).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), ts.alias("ts"), op.alias("op"), F.lit(False).alias("is_first_frame"), (F.col("id") % 700).alias("width"), (F.col("id") % 300).alias("height"))


def test_one_key_of_a_million_events_uses_all_tasks(spark):
    of = long_history(spark, 1_000_000)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = ranges.replay(of, "user_id", ORDER)
        # a digest of all rows, by partition: no partition has most of them
        digest = lambda df: df.select(F.xxhash64("event_id", "phase_before", "outcome", "phase", "output", "surface", "frame").alias("h"))
        parts = digest(out).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.max("h"))
        assert max(r.n for r in parts.collect()) < 400_000
        total = lambda df: df.agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        assert total(digest(out)) == total(digest(lifecycle.replay(of, "user_id", ORDER)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_segments_join_to_the_whole_trace(spark):
    of = history(spark, 700, [1, 2, None], 5)
    parts = {}
    for r in ranges.trace_segments(of, "user_id", ORDER, segment=32, ranges=7).collect():
        assert len(r.calls) <= 32 and r.first == 32 * r.segment
        parts.setdefault(r.user_id, {})[r.segment] = r.calls
    joined = {k: [c for s in sorted(v) for c in v[s]] for k, v in parts.items()}
    whole = {r.user_id: r.trace for r in lifecycle.call_trace(of, "user_id", ORDER).collect()}
    assert joined == whole


def test_segments_of_a_long_history_are_bounded(spark):
    out = ranges.trace_segments(long_history(spark, 1_000_000), "user_id", ORDER)
    assert out.agg(F.count("*"), F.max(F.size("calls")), F.sum(F.size("calls"))).first() == (1_000, 1_000, 1_000_000)


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 3, 3], [-(2**62), 0, 2**62], [2**63 - 1, -(2**63)], [k * k for k in range(101)], [7] * 50 + [8] * 49 + [10**15]])
def test_selection_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    order = sorted(values)
    places = [0, (len(values) - 1) // 2, len(values) // 2, len(values) - 1]
    assert ranges.select(df, places, buckets=16) == [order[p] for p in places]


def test_selection_of_the_last_number_of_a_wide_part(spark):
    """It is no part's first: quotients close below a number are not rounded up to it."""
    values = [0, 2**59 - 1, 2**59, 2**62 - 1, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert ranges.select(df, range(len(values)), buckets=16) == values


def test_median_of_a_million_values(spark):
    df = spark.range(1_000_001).select((F.xxhash64("id") % 1_000_003).alias("v"))
    [low, high] = ranges.select(df, ranges.quantile_places(1_000_001))
    assert low == high == df.agg(F.median("v")).first()[0]
