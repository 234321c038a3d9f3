"""Who is in which zone, from a stream of zone events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "zone string, track string, change int, ts bigint, seq bigint"
RESIDENTS = "zone string, residents bigint, track string, change int, ts bigint, seq bigint"


class Stays(StatefulProcessor):
    """One track's zones: entering puts it into one, leaving and passing through take it out, its delete takes it out of all. Only changes leave."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.zones = handle.getMapState("zones", "zone string", "ts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").itertuples():
            if r.relation == "Deleted":
                left = sorted(z for (z,) in self.zones.keys())
            elif r.relation in ("Left", "Through"):
                left = [r.zone] if self.zones.containsKey((r.zone,)) else []
            else:
                left = []
                if r.relation == "Entered" and not self.zones.containsKey((r.zone,)):
                    self.zones.updateValue((r.zone,), (int(r.ts),))
                    out.append((r.zone, key[0], 1, r.ts, r.seq))
            for zone in left:
                self.zones.removeKey((zone,))
                out.append((zone, key[0], -1, r.ts, r.seq))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


class Residents(StatefulProcessor):
    """A zone's count after each change. Its state is one number, however many tracks are in it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "residents bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values(["ts", "seq", "track"], kind="stable")
        before = self.held.get()[0] if self.held.exists() else 0
        counts = before + changes["change"].cumsum()
        self.held.update((int(counts.iloc[-1]),))
        yield pd.DataFrame({"zone": key[0], "residents": counts, "track": changes["track"], "change": changes["change"], "ts": changes["ts"], "seq": changes["seq"]})

    def close(self) -> None:
        pass


def zone_changes(events: DataFrame) -> DataFrame:
    """Changes of which track is in which zone, with the columns of CHANGES. events: zone (null in deletes), track, relation, ts, seq."""
    return events.groupBy("track").transformWithStateInPandas(Stays(), CHANGES, "append", "none")


def zone_residents(changes: DataFrame) -> DataFrame:
    """The number of tracks in each zone after each of its changes, with the columns of RESIDENTS. changes: those of zone_changes, as a stream of their own
    (a table or topic that they are written to), as all events of a track must have passed before its zones are counted."""
    return changes.groupBy("zone").transformWithStateInPandas(Residents(), RESIDENTS, "append", "none")


def residents(changes: DataFrame) -> DataFrame:
    """The tracks that are in a zone, from a table of changes: zone, track."""
    return changes.groupBy("zone", "track").agg({"change": "sum"}).where("`sum(change)` > 0").select("zone", "track")
