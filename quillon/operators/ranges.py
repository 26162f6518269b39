"""Replay of long histories: a key's events are cut into ranges of time that are replayed side by side.

What an automaton remembers of the events before is a few running extremes, sums or last values. So a range of a key is
summed up as one row, the summaries are scanned in order of range, and each range starts from what the ones before it
leave. Windows then run within a key's range: a key with most of all events uses as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import lifecycle

#: Ranges that events are cut into, by time.
RANGES = 64
#: Relative error of the ranges' bounds.
ERROR = 0.002
#: A range has fewer than two to this power events of a key.
RANGE_SHIFT = 48
#: Calls in a segment of a trace.
SEGMENT = 1_000


def ranged(events: DataFrame, time: str, ranges: int = RANGES) -> DataFrame:
    """``events`` with ``__range``, which grows with time: bounds are quantiles of all events' times, as many on the driver as
    there are ranges. Events of one time are in one range; those without a time are in the first."""
    us = F.unix_micros(time).cast("double")
    bounds = events.select(us.alias("us")).approxQuantile("us", [k / ranges for k in range(1, ranges)], ERROR)
    passed = sum(((us >= b).cast("int") for b in sorted(set(bounds))), F.lit(0))
    return events.withColumn("__range", F.coalesce(passed, F.lit(0)))


class Within:
    """Windows of a key's range, and what the ranges before have to add."""

    def __init__(self, key: str, order: Sequence[str]) -> None:
        self.key, self.order = key, order

    def here(self) -> Window:
        """Up to the event, in its range."""
        return Window.partitionBy(self.key, "__range").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> Window:
        """Up to the event before, in its range."""
        return Window.partitionBy(self.key, "__range").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)

    def carry(self, events: DataFrame, **of: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
        """``events`` with a column for each name: an aggregate over all ranges before the event's own. Each is given as
        the aggregate within a range and the one that puts ranges together. A row for each key and range is shuffled."""
        names = events.columns
        per = events.groupBy(F.col(self.key).alias("__key0"), F.col("__range").alias("__range0")).agg(*[a.alias(name) for name, (a, _) in of.items()])
        upto = Window.partitionBy("__key0").orderBy("__range0").rowsBetween(Window.unboundedPreceding, -1)
        carried = per.select("__key0", "__range0", *[put(F.col(name)).over(upto).alias(name) for name, (_, put) in of.items()])
        # dealt by both columns: else the join would deal the events by key alone, as the scan over ranges is
        carried = carried.repartition("__key0", "__range0")
        same = F.col(self.key).eqNullSafe(F.col("__key0")) & (F.col("__range") == F.col("__range0"))
        return events.join(carried, same).select(*names, *of)


def numbered(events: DataFrame, key: str, order: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """``events`` with ``__at``: an event's number among those of its key, from 1. ``order`` begins with a timestamp."""
    within = Within(key, order)
    out = within.carry(ranged(events, order[0], ranges), __upto=(F.count("*"), F.sum))
    at = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order)).cast("long")
    return out.withColumn("__at", F.coalesce("__upto", F.lit(0)) + at).drop("__upto")


def replay(events: DataFrame, key: str, order: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """The rows and columns of ``lifecycle.replay``, each key replayed by ranges of time. ``order`` begins with a
    timestamp; ``events`` have no column whose name begins with two underscores."""
    sized = {"width", "height"} <= set(events.columns)
    within, op = Within(key, order), F.col("op")
    of = lambda name: F.when(op == name, F.col("__at"))
    # places that compare across ranges: the range, and the number in it
    here = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order)).cast("long")
    out = ranged(events, order[0], ranges).withColumn("__at", F.shiftleft(F.col("__range").cast("long"), RANGE_SHIFT) + here)
    seen = {"__pause": ("pause", F.max), "__resume": ("resume", F.max), "__prepare": ("prepare", F.min), "__render": ("render_frame", F.max)}
    out = within.carry(out, **{f"{c}0": (put(of(name)), put) for c, (name, put) in seen.items()})
    most = {F.max: F.greatest, F.min: F.least}
    out = out.withColumns({c: most[put](F.col(f"{c}0"), put(of(name)).over(within.before())) for c, (name, put) in seen.items()})
    out = lifecycle.judged(out)
    # what the outcomes leave: whether a frame was shown, and the surface's size
    shown = ((op == "render_frame") & (F.col("outcome") == "ok")).cast("int")
    left = {"__shown0": (F.max(shown), F.max)}
    if sized:
        given = lifecycle.given_size()
        latest = F.max(F.when(given.isNotNull(), F.struct("__at", given.alias("size"))))
        left["__size0"] = (latest, F.max)
    out = within.carry(out, **left)
    before = F.greatest(F.coalesce("__shown0", F.lit(0)), F.coalesce(F.max(shown).over(within.before()), F.lit(0)))
    out = lifecycle.with_output(out, before == 0)
    if sized:
        given = lifecycle.given_size()
        out = lifecycle.with_frame(out, F.coalesce(F.last(given, ignorenulls=True).over(within.here()), F.col("__size0.size")))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def trace_segments(events: DataFrame, key: str, order: Sequence[str], segment: int = SEGMENT, ranges: int = RANGES) -> DataFrame:
    """(key, segment, first, calls): the names of all calls in order, in segments of so many calls. ``first`` is the number
    of a segment's first call, from 0. No row is larger than a segment, however long a history is."""
    at = (F.col("__at") - 1).alias("at")
    calls = numbered(events, key, order, ranges).select(key, at, "op").withColumn("segment", F.floor(F.col("at") / segment))
    held = F.sort_array(F.collect_list(F.struct("at", "op")))
    out = calls.groupBy(key, "segment").agg(held.alias("held"))
    return out.select(key, "segment", (F.col("segment") * segment).alias("first"), F.transform("held", lambda x: x["op"]).alias("calls"))


def quantile_places(n: int) -> list[int]:
    """The places, from 0, whose mean is the median of n numbers."""
    return [(n - 1) // 2, n // 2]


def select(values: DataFrame, places: Sequence[int], buckets: int = 4_096) -> list[int]:
    """The numbers (bigint, of the only column) at some places in order of size, exactly.

    Each pass counts the numbers in equal parts of the range that is left to each place: the driver sees counts of at
    most ``buckets`` parts a place, no task holds more, and a few passes leave one number."""
    name = values.columns[0]
    low, high = values.agg(F.min(name), F.max(name)).first()
    open_ = {p: (int(low), int(high), int(p)) for p in dict.fromkeys(places)}  # low, high, place within
    while any(a < b for a, b, _ in open_.values()):
        spans = sorted({(a, b) for a, b, _ in open_.values() if a < b})
        width = {s: -(-(s[1] - s[0] + 1) // buckets) for s in spans}
        # decimals carry the difference; the remainder goes first, as a quotient keeps six digits and is rounded
        whole = lambda x: x.cast("decimal(38,0)")
        above = lambda s: whole(F.col(name)) - whole(F.lit(s[0]))
        part = lambda s: ((above(s) - above(s) % whole(F.lit(width[s]))) / whole(F.lit(width[s]))).cast("int")  # noqa: B023, E731
        within = [F.when(F.col(name).between(*s), F.struct(F.lit(i).alias("i"), part(s).alias("part"))) for i, s in enumerate(spans)]
        counts = values.select(F.explode(F.array_compact(F.array(*within))).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
        of: dict[tuple[int, int], dict[int, int]] = {s: {} for s in spans}
        for r in counts.collect():
            of[spans[r["x"]["i"]]][r["x"]["part"]] = r["n"]
        for p, (a, b, k) in open_.items():
            for x, n in sorted(of.get((a, b), {}).items()):
                if k < n:
                    open_[p] = (a + x * width[a, b], min(b, a + (x + 1) * width[a, b] - 1), k)
                    break
                k -= n
    return [open_[p][0] for p in places]
