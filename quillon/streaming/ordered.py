"""Events of a key in order of time, whatever order they arrive in: the base of the stateful streams.

Events wait in the key's list state until the watermark has passed them. Then they are sorted and folded, one after
the other, into a small value state, so a stream gives what a batch over the same events gives. Events that arrive
after the watermark are dropped, as ever: ``late`` says how long to wait for them. State is best kept in RocksDB
(``spark.sql.streaming.stateStore.providerClass``), where waiting events are on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Folds a key's events in order of ``us`` and ``event_id``. Subclasses say how."""

    #: Columns of the output, of the state, and of an event after ``us`` and ``event_id``.
    OUT: str
    STATE: str
    EVENT: str

    def start(self) -> tuple:
        """The state of a key without events."""
        raise NotImplementedError

    def step(self, state: tuple, us: int, event_id: int, event: tuple) -> tuple[tuple, tuple | None]:
        """One event: the next state, and a row of output (after the key) or none."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """The time in microseconds at which the state changes by itself, if it does."""
        return None

    def expire(self, state: tuple) -> tuple[tuple, tuple | None]:
        """What happens at that time."""
        raise NotImplementedError

    # ---- the stream's side

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = [c.split(" ") for c in f"us long, event_id long, {self.EVENT}".split(", ")]
        self._columns = [(name, {"long": int, "boolean": bool}.get(kind, str)) for name, kind in kinds]
        self.state = handle.getValueState("state", self.STATE)
        self.waiting = handle.getListState("waiting", f"us long, event_id long, {self.EVENT}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for part in rows:
            # numbers beside nulls come as floats
            columns = [[None if pd.isna(x) else as_(x) for x in part[name]] for name, as_ in self._columns]
            new = list(zip(*columns))
            self.waiting.appendList(new)
            least = min(r[0] for r in new)
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first, timerValues)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        # nothing at or before the watermark comes any more
        upto = timerValues.getCurrentWatermarkInMs() * 1_000
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
        ready = [e for e in events if e[0] <= upto]
        rest = events[len(ready) :]
        state, out = tuple(self.state.get()) if self.state.exists() else self.start(), []
        for us, event_id, *event in ready:
            state = self._expired(state, us - 1, out, key)
            state, row = self.step(state, us, event_id, tuple(event))
            if row is not None:
                out.append((key[0], *row))
        state = self._expired(state, upto, out, key)
        self.state.update(state)
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self._wake(rest[0][0], timerValues)
        if (at := self.due(state)) is not None:
            self._wake(at, timerValues)
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in self.OUT.split(", ")])

    def _expired(self, state: tuple, upto: int, out: list, key: tuple) -> tuple:
        """The state at a time, after what is due by then."""
        while (at := self.due(state)) is not None and at <= upto:
            state, row = self.expire(state)
            if row is not None:
                out.append((key[0], *row))
        return state

    def _wake(self, us: int, timerValues) -> None:  # noqa: ANN001, N803
        """A timer for when the watermark has passed a time."""
        self.handle.registerTimer(max(-(-us // 1_000), timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def folded(events: DataFrame, key: str, late: str, fold: OrderedFold, *columns: str) -> DataFrame:
    """A stream of ``events`` (key, ts, event_id, columns) folded by key, in append mode."""
    timed = events.withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("us"), "event_id", *columns, "ts")
    # the event time has to stay in the rows that are grouped
    return timed.groupBy("key").transformWithStateInPandas(fold, fold.OUT, "append", "eventTime")
