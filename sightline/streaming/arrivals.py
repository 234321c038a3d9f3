"""Tracks of a stream in spans of arrival, and global tracks from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sightline.operators import global_tracks

EVENT = {
    "tracklet": "string", "association": "string", "associated": "boolean", "n_members": "int", "assoc_first_ts": "bigint", "first_ts": "bigint",
    "ts": "bigint", "seq": "bigint", "x": "double", "y": "double", "is_deleted": "boolean",
}
PLACED = "lane string, w_begin bigint, last_gone boolean, " + ", ".join(f"{c} {t}" for c, t in EVENT.items())


class Spans(StatefulProcessor):
    """Tracks of one lane wait until their span is over: when a track comes `span` or more after its first one, or `idle` milliseconds of the clock after
    that one came. A span leaves as a whole, in one batch. A track that is late belongs to the span that is open.

    States: `events` (of the open span), `first` (its first time, and the clock's when it came), `gone` (association to tracklets that are deleted).
    """

    def __init__(self, span: int, idle: int):
        self.span, self.idle = span, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", ", ".join(f"{c} {t}" for c, t in EVENT.items()))
        self.first = handle.getValueState("first", "ts bigint, came bigint")
        self.gone = handle.getMapState("gone", "association string", "tracklets array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = sorted((e for f in rows for e in zip(*(f[c].tolist() for c in EVENT))), key=lambda e: (e[6], e[7]))
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle else 0
        first, since = self.first.get() if self.first.exists() else (None, now)
        if self.idle and first is not None and now - since >= self.idle:
            # The timer was due before these came.
            yield self.leave(key, first, list(self.events.get()))
            self.events.clear()
            first = None
        pending: list[tuple] = []
        for e in came:
            if first is not None and e[6] - first >= self.span:
                yield self.leave(key, first, [*self.events.get(), *pending])
                self.events.clear()
                pending, first = [], None
            if first is None:
                first, since = e[6], now
            pending.append(e)
        self.first.update((first, since))
        if pending:
            self.events.appendList(pending)
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(since + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.first.exists():
            yield self.leave(key, self.first.get()[0], list(self.events.get()))
            self.events.clear()
            self.first.clear()

    def leave(self, key, first: int, events: list) -> pd.DataFrame:
        out = []
        for e in sorted((tuple(e) for e in events), key=lambda e: (e[6], e[7])):
            last = False
            if e[10]:
                gone = set(self.gone.getValue((e[1],))[0]) if self.gone.containsKey((e[1],)) else set()
                last = len(gone | {e[0]}) >= e[3]
                if not last:
                    self.gone.updateValue((e[1],), (sorted(gone | {e[0]}),))
                elif self.gone.containsKey((e[1],)):
                    self.gone.removeKey((e[1],))
            out.append((key[0], first, last, *e))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PLACED.split(", ")])

    def close(self) -> None:
        pass


def spans(tracks: DataFrame, span: int = 100, idle: int = 0) -> DataFrame:
    """Tracks with the begin of their span, given out when it is over, with the columns of PLACED; `last_gone` marks the delete after which all of
    an association's `n_members` are deleted.

    tracks: lane (not null) and the columns of EVENT, none of them null but x and y. Without `idle` there are no timers, and the last span stays open.
    """
    told = tracks.where("lane is not null").select("lane", *EVENT)
    return told.groupBy("lane").transformWithStateInPandas(Spans(span, idle), PLACED, "append", "processingTime" if idle else "none")


def global_tracks_by_arrival(tracks: DataFrame, write, checkpoint: str, span: int = 100, idle: int = 0):
    """Global tracks of a stream as `write(rows, batch)` gets them, see `global_tracks.in_arrival_spans`. As a span leaves in one batch, what a batch
    says of it is whole. Tracks without a lane are for `global_tracks.one_by_one`, which needs no state."""
    return spans(tracks, span, idle).writeStream.foreachBatch(lambda rows, number: write(global_tracks.combined(rows), number)).option("checkpointLocation", checkpoint)
