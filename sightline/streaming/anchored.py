"""Hopping windows whose phase an event sets, as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sightline.operators.aggregation import Aggregator, names


class Windows(StatefulProcessor):
    """Open windows of a key, each with a partial state.

    An event newer than all before closes the windows that have ended `grace` before it; then it starts a window, if none is open, and all that hop from the
    last one up to it. An older event counts in the open windows that cover it, and is lost if there are none. A row without a time ends its key: all windows
    close, as they do once the key has been silent for `idle` milliseconds of the clock. Windows without events give nothing.
    """

    def __init__(self, size: int, advance: int, grace: int, idle: int, aggregator: Aggregator, key: str):
        self.size, self.advance, self.grace, self.idle, self.aggregator, self.key = size, advance, grace, idle, aggregator, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "newest bigint, begins array<bigint>")
        self.states = handle.getMapState("states", "w_begin bigint", self.aggregator.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, begins = self.clock.get() if self.clock.exists() else (-(1 << 62), [])
        begins, closed, of = list(begins), [], {}
        came = pd.concat(list(rows)).sort_values("seq", kind="stable").reset_index(drop=True)
        ends = came.ts.isna()
        for i, ts in enumerate(came.ts.where(~ends, 0).astype("int64").tolist()):
            if ends[i]:
                # A window of the same begin may come again, so what has closed is given out at once.
                closed += self.close_all(key, begins, of, came)
                begins = []
                continue
            if ts > newest:
                newest = ts
                done = [b for b in begins if b + self.size + self.grace <= ts]
                closed += self.close_all(key, done, of, came)
                begins = [b for b in begins if b + self.size + self.grace > ts] or [ts]
                while begins[-1] + self.advance <= ts:
                    begins.append(begins[-1] + self.advance)
            for b in begins:
                if b <= ts < b + self.size:
                    of.setdefault(b, []).append(i)
        for b, places in of.items():
            self.states.updateValue((b,), self.state(b, came.iloc[places]))
        self.clock.update((newest, begins))
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self.frame(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, begins = self.clock.get()
        closed = self.close_all(key, list(begins), {}, None)
        self.clock.update((newest, []))
        yield self.frame(closed)

    def state(self, begin: int, rows: pd.DataFrame | None) -> tuple | None:
        """What a window holds, with rows added."""
        columns = names(self.aggregator.STATE)
        held = pd.DataFrame([tuple(self.states.getValue((begin,)))] if self.states.containsKey((begin,)) else [], columns=columns).assign(w_begin=begin)
        if rows is not None:
            new = self.aggregator.partial(rows.assign(w_begin=begin), ["w_begin"])
            held = self.aggregator.merge(pd.concat([held, new]), ["w_begin"]) if len(held) else new
        return next(zip(*(held[c].tolist() for c in columns)), None)

    def close_all(self, key, begins: list[int], of: dict, came: pd.DataFrame | None) -> list[tuple]:
        done = []
        for b in begins:
            state = self.state(b, came.iloc[of.pop(b)] if b in of else None)
            if state is not None:
                done.append((b, *state))
            if self.states.containsKey((b,)):
                self.states.removeKey((b,))
        if not done:
            return []
        out = self.aggregator.close(pd.DataFrame(done, columns=["w_begin", *names(self.aggregator.STATE)])).assign(**{self.key: key[0]})
        return list(zip(*(out[c].tolist() for c in (self.key, "w_begin", *names(self.aggregator.OUT)))))

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "w_begin", *names(self.aggregator.OUT)])

    def close(self) -> None:
        pass


def anchored_windows(df: DataFrame, key: str, size: int, advance: int, aggregator: Aggregator, grace: int = 0, idle: int = 0) -> DataFrame:
    """For each key and window, once it has closed: key, w_begin, and the aggregator's OUT (see Windows). df: key, ts, seq (order of arrival within a
    batch), and what the aggregator reads. With grace 0 and events in order, the windows are those of `windows.reanchored`."""
    shape = f"`{key}` {df.schema[key].dataType.simpleString()}, w_begin bigint, {aggregator.OUT}"
    return df.groupBy(key).transformWithStateInPandas(Windows(size, advance, grace, idle, aggregator, key), shape, "append", "processingTime" if idle else "none")
