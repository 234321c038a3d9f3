"""Matching of tracklets by appearance as a stream: sessions that gather features, wait for their zone and their turn, and are matched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sightline.operators.feature import chosen_candidate
from sightline.streaming.flows import timed

MATCHES = "network string, session bigint, candidate bigint, exit_node string, score double, boosted double"


class Matcher(StatefulProcessor):
    """The sessions of one network of linked cameras, in order of their start.

    A session gathers features until it has `wanted` of them or is deleted, waits until its zone is known and until the watermark has passed its start, so
    that whatever left another camera before it is in the index, and is matched as soon as no earlier session waits. A candidate among the last
    `held` matches is not matched again. A session that is silent for `ttl` without having gathered enough is given up, so that it holds nobody.

    States: `sessions` that wait, `features` (the first ones of each tracklet), `index` (zones and times of tracklets), `taken`. What is older than
    the longest transition and `ttl` can be of no use any more and goes.
    """

    def __init__(self, links: list[tuple], wanted: int, share: float, held: int, ttl: int):
        self.links, self.wanted, self.share, self.held, self.ttl = links, wanted, share, held, ttl
        self.longest = max((link[5] for link in links), default=0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session bigint", "node string, start bigint, seen bigint, closed boolean")
        self.features = handle.getMapState("features", "track bigint, place int", "feature array<double>")
        self.counts = handle.getMapState("counts", "track bigint", "n int, ts bigint, closed boolean")
        self.index = handle.getMapState("index", "track bigint", "node string, enter_zone string, exit_zone string, last_ts bigint, ts bigint")
        self.taken = handle.getValueState("taken", "candidates array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, touched = timerValues.getCurrentWatermarkInMs(), set()
        for frame in rows:
            for r in frame.sort_values(["ts", "seq"], kind="stable").itertuples():
                track, known = (int(r.track),), self.index.getValue((int(r.track),)) if self.index.containsKey((int(r.track),)) else (r.node, None, None, -1, 0)
                if r.kind == "zone":
                    self.index.updateValue(track, (r.node, r.enter_zone or known[1], r.exit_zone or known[2], max(int(r.last_ts), known[3]), int(r.ts)))
                    continue
                n, _, closed = self.counts.getValue(track) if self.counts.containsKey(track) else (0, 0, False)
                if not self.counts.containsKey(track):
                    self.sessions.updateValue(track, (r.node, int(r.ts), int(r.ts), False))
                    touched.add(int(r.ts))
                if r.feature is None:
                    closed = True
                elif n < self.wanted and not closed:
                    self.features.updateValue((track[0], n), ([float(x) for x in r.feature],))
                    n += 1
                self.counts.updateValue(track, (n, int(r.ts), closed))
                if self.sessions.containsKey(track):
                    node, start, _, _ = self.sessions.getValue(track)
                    self.sessions.updateValue(track, (node, start, int(r.ts), closed))
        for start in touched:
            for at in (start + 1, start + self.ttl + 1):
                if at > now:
                    self.handle.registerTimer(at)
        yield from self.matched(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        yield from self.matched(key, now)
        self.purge(now)

    def matched(self, key, now: int) -> Iterator[pd.DataFrame]:
        out = []
        taken = list(self.taken.get()[0]) if self.taken.exists() else []
        waiting = sorted(((start, s, node, seen, closed) for (s,), (node, start, seen, closed) in self.sessions.iterator()), key=lambda w: w[:2])
        for start, session, node, seen, closed in waiting:
            if start > now:
                break
            silent, ready = seen + self.ttl <= now, closed or self.counts.getValue((session,))[0] >= self.wanted
            zone = self.index.getValue((session,))[1] if self.index.containsKey((session,)) else None
            if not silent and (not ready or zone is None):
                break
            self.sessions.removeKey((session,))
            best = chosen_candidate(self.candidates(session, node, zone, start), taken, self.held) if ready and zone is not None else None
            if best is not None:
                taken = [*taken, int(best.candidate.iloc[0])][-self.held :]
                out.append((key[0], session, *best[["candidate", "exit_node", "score", "boosted"]].itertuples(index=False, name=None).__next__()))
        if out:
            self.taken.update((taken,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MATCHES.split(", ")])

    def vectors(self, track: int) -> np.ndarray:
        n, _, closed = self.counts.getValue((track,)) if self.counts.containsKey((track,)) else (0, 0, False)
        return np.array([self.features.getValue((track, k))[0] for k in range(n)]) if closed or n >= self.wanted else np.empty((0, 0))

    def candidates(self, session: int, node: str, zone: str, start: int) -> pd.DataFrame:
        """Tracklets that left a linked zone within the transition time before the session, with the k-th best score of all feature pairs."""
        mine, rows = self.vectors(session), []
        ways = {(link[2], link[3]): (start - link[5], start - link[4]) for link in self.links if link[:2] == (node, zone)}
        for (track,), (exit_node, _, exit_zone, last, _) in self.index.iterator() if ways and len(mine) else ():
            low, high = ways.get((exit_node, exit_zone), (1, 0))
            if track != session and last >= 0 and low <= last <= high:
                theirs = self.vectors(track)
                if len(theirs):
                    scores = np.sort(np.round(1 - mine @ theirs.T, 6), axis=None)[::-1]
                    rows.append((track, exit_node, last, float(scores[max(1, int(len(scores) * self.share + 0.5)) - 1])))
        return pd.DataFrame(rows, columns=["candidate", "exit_node", "last_ts", "score"])

    def purge(self, now: int) -> None:
        """Forget tracklets that closed, or fell silent, so long ago that no session can ask for them."""
        old = now - self.longest - self.ttl
        for (track,), (n, ts, _) in list(self.counts.iterator()):
            if ts < old and not self.sessions.containsKey((track,)):
                for k in range(n):
                    self.features.removeKey((track, k))
                self.counts.removeKey((track,))
        for (track,), (_, _, _, last, ts) in list(self.index.iterator()):
            if max(last, ts) < old:
                self.index.removeKey((track,))

    def close(self) -> None:
        pass


def matches(features: DataFrame, index: DataFrame, links: list[tuple], wanted: int = 5, share: float = 0.2, held: int = 64, ttl: int = 600_000, grace: str = "0 seconds") -> DataFrame:
    """Matches of sessions with what left linked cameras before them, with the columns of MATCHES.

    features: network, node, track, feature (null: the tracklet is deleted), ts, seq. index: network, node, track, enter_zone, exit_zone (null while
    unknown), last_ts (-1 while open), ts. links: enter_node, enter_zone, exit_node, exit_zone, min_ms, max_ms; a site has few. Needs the
    provider of keyed states that `publication` names.
    """
    nothing = lambda t: F.lit(None).cast(t)
    told = features.select("network", F.lit("feature").alias("kind"), "node", "track", "feature", "ts", "seq", nothing("string").alias("enter_zone"), nothing("string").alias("exit_zone"), nothing("bigint").alias("last_ts"))
    zones = index.select("network", F.lit("zone").alias("kind"), "node", "track", nothing("array<float>").alias("feature"), "ts", F.lit(0).cast("bigint").alias("seq"), "enter_zone", "exit_zone", "last_ts")
    return timed(told.unionByName(zones), grace).groupBy("network").transformWithStateInPandas(Matcher(links, wanted, share, held, ttl), MATCHES, "append", "eventTime")
