"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.operators import indexes


def timed(df: DataFrame, grace: str) -> DataFrame:
    """Event time from the record, and a watermark behind it."""
    return df.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", grace)


def window_means(df: DataFrame, size: str, advance: str | None = None, grace: str = "0 seconds", keys: tuple[str, ...] = ("node",)) -> DataFrame:
    """Mean location, last time and count of each key and window, given out once the watermark has passed the window's end."""
    window = F.window("event_time", size, advance or size)
    found = timed(df.where(~F.col("is_deleted")), grace).groupBy(window, *keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("ts").alias("ts"), F.count("*").alias("n"))
    return found.select(*keys, F.unix_millis("window.start").alias("w_begin"), "x", "y", "ts", "n")


def enriched(df: DataFrame, associations: DataFrame, wait: str = "3 minutes") -> DataFrame:
    """Tracks joined with associations that arrive within `wait`; later or never: an association of their own."""
    left = timed(df, "0 seconds")
    right = associations.select(F.col("tracklet").alias("__t"), "association", F.timestamp_millis("ts").alias("__at")).withWatermark("__at", wait)
    within = (F.col("tracklet") == F.col("__t")) & (F.col("__at") <= F.col("event_time") + F.expr(f"interval {wait}")) & (F.col("__at") >= F.col("event_time") - F.expr(f"interval {wait}"))
    return left.join(right, within, "leftOuter").withColumn("association", F.coalesce("association", "tracklet")).drop("__t", "__at")


TRACK = "ts bigint, seq bigint, x double, y double, first_ts bigint, is_deleted boolean"


def associated(tracks: DataFrame, associations: DataFrame, wait: int = 180_000, ttl: int = 3_600_000) -> DataFrame:
    """Tracks with their association, held back until it is known: tracklet, association, assoc_first_ts, and the columns of TRACK.

    tracks: tracklet and the columns of TRACK; associations: tracklet, association, first_ts, ts. A track leaves once the association of its
    tracklet has come. After `wait` milliseconds of event time without one, the tracklet becomes an association of its own, which is remembered, so
    that its later tracks don't wait either; an association that comes later still takes its place. The state of a tracklet goes with its delete,
    or when it has been silent for `ttl`. Rows leave at most `wait` behind, which is the watermark's delay, so windows can follow.
    """
    names = [c.split()[0] for c in TRACK.split(", ")]
    sent = associations.select("tracklet", "association", "first_ts", "ts").withColumns({"seq": F.lit(-1).cast("long"), "x": F.lit(None).cast("double"), "y": F.lit(None).cast("double"), "is_deleted": F.lit(False)})
    both = tracks.select("tracklet", *names).withColumn("association", F.lit(None).cast("string")).unionByName(sent)
    columns = ["tracklet", "association", "assoc_first_ts", *names]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, since, seen, *held = state.get if state.exists else (None, None, 0, *([] for _ in names))
        pending = list(zip(*held))
        for f in frames:
            for r in f.itertuples():
                seen = max(seen, int(r.ts))
                if r.association is not None:
                    known, since = r.association, int(r.first_ts)
                else:
                    pending.append(tuple(getattr(r, n) for n in names))
        pending.sort(key=lambda p: p[:2])
        now = state.getCurrentWatermarkMs()
        if known is None and pending and pending[0][0] <= now:
            known, since = key[0], int(pending[0][names.index("first_ts")])
        out = pending if known is not None else []
        pending = [] if known is not None else pending
        ended = any(p[-1] for p in out) or (state.hasTimedOut and not pending and seen + ttl <= now)
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((known, since, seen, *([p[k] for p in pending] for k in range(len(names)))))
            state.setTimeoutTimestamp(max(now + 1, pending[0][0] + 1 if pending else seen + ttl))
        yield pd.DataFrame([(key[0], known, since, *p) for p in out], columns=columns)

    shape = f"tracklet string, association string, assoc_first_ts bigint, {TRACK}"
    kept = "association string, since bigint, seen bigint, " + ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in TRACK.split(", "))
    return timed(both, f"{wait} milliseconds").groupBy("tracklet").applyInPandasWithState(step, shape, kept, "append", GroupStateTimeout.EventTimeTimeout)


def closing_windows(df: DataFrame, size: int, grace: int = 0, idle: int = 1000, key: str = "node") -> DataFrame:
    """Tumbling windows of each key: key, w_begin, x and y (means), ts (last), n. A window is given out once an event of its key comes `grace`
    after its end, or once no event of the key has come for `idle` milliseconds of the clock: then nothing is left open, so that the last windows of
    a source that stops come out, too. Events of windows that are out already are dropped. State is a sum for each open window."""
    columns = [key, "w_begin", "x", "y", "ts", "n"]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, newest, *sums = state.get if state.exists else (-(1 << 62), -(1 << 62), *([] for _ in range(5)))
        held = {b: list(s) for b, *s in zip(*sums)}
        if not state.hasTimedOut:
            for f in frames:
                for ts, x, y in zip(f.ts.tolist(), f.x.tolist(), f.y.tolist()):
                    newest, b = max(newest, ts), ts // size * size
                    if b >= closed:
                        s = held.setdefault(b, [0.0, 0.0, ts, 0])
                        held[b] = [s[0] + x, s[1] + y, max(s[2], ts), s[3] + 1]
        done = sorted(b for b in held if state.hasTimedOut or b + size + grace <= newest)
        closed = max([closed, *(b + size for b in done)])
        rows = [(k[0], b, held[b][0] / held[b][3], held[b][1] / held[b][3], held[b][2], held[b][3]) for b in done]
        left = sorted((b, *s) for b, s in held.items() if b not in done)
        state.update((closed, newest, *(list(c) for c in (zip(*left) if left else [[]] * 5))))
        if left:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(rows, columns=columns)

    kept = "closed bigint, newest bigint, w array<bigint>, x array<double>, y array<double>, ts array<bigint>, n array<bigint>"
    return df.where(~F.col("is_deleted")).groupBy(key).applyInPandasWithState(step, f"{key} string, w_begin bigint, x double, y double, ts bigint, n bigint", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_index(df: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("node", "track_id")):
    """Keep an index as a table of versions: each batch writes what it says of its keys (`indexes.partial_index`), a row a key, as a new version, so a
    repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        indexes.partial_index(batch, list(keys)).write.mode("overwrite").parquet(f"{path}/version={number:09d}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_index(versions: DataFrame, keys: tuple[str, ...] = ("node", "track_id")) -> DataFrame:
    """The index over all versions written so far: their rows are put together, and no event is read again."""
    return indexes.combined_index(versions, list(keys))


def delayed(df: DataFrame, delay: int, key: str = "node") -> DataFrame:
    """A delay line: events of a key leave in order of time once the key has an event that is `delay` milliseconds younger, or the watermark has passed."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get)] if state.exists else []
        for f in frames:
            held += list(zip(f.ts.tolist(), f.seq.tolist()))
        held.sort()
        newest = float("inf") if state.hasTimedOut else held[-1][0]
        out = [h for h in held if newest - h[0] >= delay]
        held = held[len(out) :]
        if held:
            state.update(([h[0] for h in held], [h[1] for h in held]))
            state.setTimeoutTimestamp(max(held[-1][0] + delay, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(out), "ts": [h[0] for h in out], "seq": [h[1] for h in out]})

    shape, kept = f"{key} string, ts bigint, seq bigint", "ts array<bigint>, seq array<bigint>"
    return timed(df, "0 seconds").groupBy(key).applyInPandasWithState(step, shape, kept, "append", GroupStateTimeout.EventTimeTimeout)
