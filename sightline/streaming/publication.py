"""Global tracks from a stream of tracks, window by window and in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sightline.streaming.flows import timed

#: Keyed states are kept in RocksDB: a batch reads and writes those rows alone that it touches.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PUBLISHED = "lane string, place bigint, association string, w_begin bigint, x double, y double, ts bigint, first_ts bigint, n_supports bigint, n_tracklets bigint, state string"
EVENT = {"tracklet": "string", "ts": "bigint", "seq": "bigint", "x": "double", "y": "double", "first_ts": "bigint", "is_deleted": "boolean"}


class Publisher(StatefulProcessor):
    """Windows of one lane wait in a queue, and the first of them leaves once it has ended and each of its tracks has an association.

    States: `known` (tracklet to association), `windows` (begin to its events), `gone` (association to the members that are deleted), and `clock`
    (newest time seen, end of the last window closed, rows published). A track that has waited longer than `wait` gets an association of its own, which is
    remembered, until another one comes. A source that has been silent for `idle` milliseconds of the clock gets its open windows closed; tracks in
    them that have no association don't wait any longer then. Events of windows that are closed already are dropped.
    """

    def __init__(self, interval: int, grace: int, wait: int, idle: int):
        self.interval, self.grace, self.wait, self.idle = interval, grace, wait, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "tracklet string", "association string, first_ts bigint, members string, alone boolean")
        self.windows = handle.getMapState("windows", "w_begin bigint", ", ".join(f"{c} array<{t}>" for c, t in EVENT.items()))
        self.gone = handle.getMapState("gone", "association string", "members string, ts bigint")
        self.clock = handle.getValueState("clock", "newest bigint, closed bigint, place bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, closed, place = self.clock.get() if self.clock.exists() else (-(1 << 62), -(1 << 62), 0)
        came: dict[int, list[tuple]] = {}
        for frame in rows:
            for r in frame[frame.association.notna()].itertuples():
                self.known.updateValue((r.tracklet,), (r.association, int(r.first_ts), r.members, False))
            tracks = frame[frame.association.isna()]
            for event in zip(*(tracks[c].tolist() for c in EVENT)):
                newest, begin = max(newest, event[1]), event[1] // self.interval * self.interval
                if begin >= closed:
                    came.setdefault(begin, []).append(event)
        for begin, events in came.items():
            held = list(zip(*self.windows.getValue((begin,)))) if self.windows.containsKey((begin,)) else []
            self.windows.updateValue((begin,), tuple(list(c) for c in zip(*held, *events)))
        until = (newest - self.grace) // self.interval * self.interval
        yield from self.publish(key, newest, max(closed, until), place, False)
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, closed, place = self.clock.get()
        yield from self.publish(key, newest, max(closed, newest + self.interval), place, True)

    def publish(self, key, newest: int, closed: int, place: int, silent: bool) -> Iterator[pd.DataFrame]:
        out = []
        for begin in sorted(b for (b,) in self.windows.keys()):
            if begin + self.interval > closed:
                break
            events = sorted(zip(*self.windows.getValue((begin,))), key=lambda e: (e[1], e[2]))
            of = {}
            for tracklet, ts, _, _, _, first_ts, _ in events:
                if tracklet not in of:
                    known = self.known.getValue((tracklet,)) if self.known.containsKey((tracklet,)) else None
                    if known is None and (silent or newest - ts > self.wait):
                        known = (tracklet, first_ts, tracklet, True)
                        self.known.updateValue((tracklet,), known)
                    of[tracklet] = known
            if None in of.values():
                break
            self.windows.removeKey((begin,))
            out += self.rows(begin, events, of)
        self.clock.update((newest, closed, place + len(out)))
        names = [c.split()[0] for c in PUBLISHED.split(", ")]
        yield pd.DataFrame([(key[0], place + i, *row) for i, row in enumerate(out)], columns=names)

    def rows(self, begin: int, events: list[tuple], of: dict) -> list[tuple]:
        """What a window has to say: of each association its mean place, then that it is deleted, if its last member is."""
        groups: dict[str, list[tuple]] = {}
        for e in events:
            groups.setdefault(of[e[0]][0], []).append(e)
        out = []
        for association in sorted(groups):
            own = groups[association]
            alive, ended = [e for e in own if not e[6]], [e for e in own if e[6]]
            first = min(of[e[0]][1] for e in own)
            if alive:
                n, state = len(alive), "ISOLATED" if all(of[e[0]][3] for e in alive) else "ASSOCIATED"
                out.append((association, begin, round(sum(e[3] for e in alive) / n, 6), round(sum(e[4] for e in alive) / n, 6), max(e[1] for e in alive), first, n, len({e[0] for e in alive}), state))
            if ended:
                members = set(of[ended[0][0]][2].split(" "))
                seen, last = self.gone.getValue((association,)) if self.gone.containsKey((association,)) else ("", 0)
                gone, last = set(seen.split()) | {e[0] for e in ended}, max(last, *(e[1] for e in ended))
                if members <= gone:
                    out.append((association, begin, None, None, last, first, 0, 0, "DELETED"))
                    if self.gone.containsKey((association,)):
                        self.gone.removeKey((association,))
                else:
                    self.gone.updateValue((association,), (" ".join(sorted(gone)), last))
                for e in ended:
                    self.known.removeKey((e[0],))
        return out

    def close(self) -> None:
        pass


def published(tracks: DataFrame, associations: DataFrame, interval: int = 100, grace: int = 100, wait: int = 180_000, idle: int = 0) -> DataFrame:
    """Global tracks in order of time, with the columns of PUBLISHED. `place` numbers the rows of a lane.

    tracks: lane, tracklet, ts, seq, x, y, first_ts, is_deleted. associations: lane, tracklet, association, first_ts, members (all tracklets of the
    association, parted by blanks), ts. Tracks of one lane (an area, a site) come out in the order of their windows; lanes don't wait for each other.
    With `idle`, a stream has timers of the clock and goes on until it is stopped; without, it can end with its input. Where the session keeps state
    elsewhere, set PROVIDER first.
    """
    told = tracks.select("lane", *EVENT).withColumns({"association": F.lit(None).cast("string"), "members": F.lit(None).cast("string")})
    nothing = {c: F.lit(None).cast(t) for c, t in EVENT.items() if c not in ("tracklet", "ts", "first_ts")}
    known = associations.select("lane", "tracklet", "association", "first_ts", "members", "ts").withColumns(nothing)
    both = timed(told.unionByName(known), "0 seconds")
    return both.groupBy("lane").transformWithStateInPandas(Publisher(interval, grace, wait, idle), PUBLISHED, "append", "processingTime" if idle else "none")
