"""Tracks of objects across cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry
from sightline.operators.tables import materialize
from sightline.operators.windows import arrival_spans, hopping


def enrich(tracks: DataFrame, assigned: DataFrame) -> DataFrame:
    """Each track with its association, or one of its own if it has none. assigned: tracklet, association, first_ts."""
    given = assigned.select("tracklet", F.col("association").alias("__a"), F.col("first_ts").alias("__f"))
    joined = tracks.join(given, "tracklet", "left")
    return joined.select(*tracks.columns, F.coalesce("__a", "tracklet").alias("association"), F.coalesce("__f", "first_ts").alias("assoc_first_ts"), F.col("__a").isNotNull().alias("associated"))


def global_tracks(enriched: DataFrame, interval: int = 100) -> DataFrame:
    """Mean location, last time and number of supports of each association and interval."""
    placed = hopping(enriched.where(~F.col("is_deleted")), interval)
    found = placed.groupBy("association", "w_begin").agg(
        F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.max("ts").alias("ts"), F.min("assoc_first_ts").alias("first_ts"), F.count("*").alias("n_supports"), F.count_distinct("tracklet").alias("n_tracklets"), F.bool_or("associated").alias("__a")
    )
    return found.withColumn("state", F.when(F.col("__a"), "ASSOCIATED").otherwise("ISOLATED")).drop("__a")


def deletions(enriched: DataFrame) -> DataFrame:
    """Associations whose tracklets are all deleted, with the time of the last delete."""
    each = enriched.groupBy("association", "tracklet").agg(F.max(F.when(F.col("is_deleted"), F.col("ts"))).alias("gone"))
    found = each.groupBy("association").agg(F.count("*").alias("n"), F.count("gone").alias("d"), F.max("gone").alias("ts"))
    return found.where("n = d").select("association", "ts", F.lit("DELETED").alias("state"))


SPOKEN = ["lane", "w_begin", "association", "state", "x", "y", "first_ts", "ts", "n_supports"]


def combined(placed: DataFrame) -> DataFrame:
    """What whole spans of overlapping views say: for each association its mean place; a tracklet without one by itself, with the first time of its last
    event; and DELETED where `last_gone` marks the delete that was the last of an association's.

    placed: enriched tracks with lane, w_begin and last_gone.
    """
    alive = placed.where("not is_deleted").groupBy("lane", "w_begin", "association").agg(
        F.when(F.bool_or("associated"), "ASSOCIATED").otherwise("ISOLATED").alias("state"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"),
        F.when(F.bool_or("associated"), F.min("assoc_first_ts")).otherwise(F.max_by("first_ts", F.struct("ts", "seq"))).alias("first_ts"), F.max("ts").alias("ts"), F.count("*").alias("n_supports"),
    )
    gone = placed.where("last_gone").select("lane", "w_begin", "association", F.lit("DELETED").alias("state"), *(F.lit(None).cast("double").alias(c) for c in "xy"), F.col("assoc_first_ts").alias("first_ts"), "ts", F.lit(0).cast("long").alias("n_supports"))
    return alive.select(*SPOKEN).unionByName(gone)


def one_by_one(outside: DataFrame) -> DataFrame:
    """Tracks that no overlapping view sees, each as a global track of its own: deletes under the tracklet's name, others under the association's."""
    gone = F.col("is_deleted")
    place = lambda c: F.when(~gone, F.round(c, 6)).alias(c)
    state = F.when(gone, "DELETED").when(F.col("associated"), "ASSOCIATED").otherwise("ISOLATED")
    name = F.when(gone, F.col("tracklet")).otherwise(F.col("association"))
    return outside.select("lane", F.col("ts").alias("w_begin"), name.alias("association"), state.alias("state"), place("x"), place("y"), "first_ts", "ts", F.when(gone, 0).otherwise(1).cast("long").alias("n_supports"))


def in_arrival_spans(enriched: DataFrame, span: int = 100) -> DataFrame:
    """Global tracks by arrival: tracks of overlapping views (a lane each) are put together for each span (see `windows.arrival_spans`), the others
    pass one by one. An association is deleted once all of its tracklets are that the lane has seen; of deletes at one time the last seq counts.

    enriched: as `enrich` gives it, with x, y, ts, seq, first_ts, is_deleted, and lane (null: no overlapping view).
    """
    placed = materialize(arrival_spans(enriched.where("lane is not null"), span, ["lane"]))
    each = placed.groupBy("lane", "association", "tracklet").agg(F.max(F.when(F.col("is_deleted"), F.struct("ts", "seq"))).alias("gone"))
    ended = each.groupBy("lane", "association").agg(F.count("*").alias("n"), F.count("gone").alias("d"), F.max("gone").alias("__gone")).where("n = d")
    # Deletes alone meet the ends of associations; what is alive, of which an association may have any share, is only summed.
    deletes = placed.where("is_deleted").join(ended.select("lane", "association", "__gone"), ["lane", "association"])
    deletes = deletes.where(F.struct("ts", "seq") == F.col("__gone")).select(*placed.columns).withColumn("last_gone", F.lit(True))
    told = placed.where("not is_deleted").withColumn("last_gone", F.lit(False)).unionByName(deletes)
    return combined(told).unionByName(one_by_one(enriched.where("lane is null")))


def isolated(tracks: DataFrame, interval: int = 100) -> DataFrame:
    """Mean location of each tracklet and interval; id, first and last time of its last event."""
    placed = hopping(tracks.where(~F.col("is_deleted")), interval)
    return placed.groupBy("tracklet", "w_begin").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.max_by("first_ts", F.struct("ts", "seq")).alias("first_ts"), F.max("ts").alias("ts"))


def trajectories(points: DataFrame, key: str, east, north) -> DataFrame:
    """The latest position of each track in degrees, its time as text, and both as a moving point."""
    at = F.struct("ts", "seq")
    latest = points.where(~F.col("is_deleted")).groupBy(key).agg(F.max_by(F.struct(east.alias("e"), north.alias("n"), "ts"), at).alias("p"))
    lon, lat = geometry.to_wgs84(F.col("p.e"), F.col("p.n"))
    stamp = F.date_format(F.timestamp_millis(F.col("p.ts")), "yyyy-MM-dd HH:mm:ss.SSS")
    found = latest.select(key, F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"), stamp.alias("stamp"))
    return found.withColumn("moving_point", F.format_string("MPOINT((%.7f %.7f) %s)", "lon", "lat", "stamp"))
