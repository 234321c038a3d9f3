"""Filters, keys and pairs of track events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.tables import small


def distance_gate(tracks: DataFrame, area_nodes: DataFrame) -> DataFrame:
    """Deletes pass; other events pass if their node is in an area and they are within its distance. Adds the area (null for deletes outside)."""
    joined = tracks.join(small(area_nodes), "node", "left")
    near = F.col("area").isNotNull() & (F.col("distance") <= F.coalesce("threshold", F.lit(float("inf"))))
    return joined.where(F.col("is_deleted") | near).drop("threshold")


def with_lanes(tracks: DataFrame, area_nodes: DataFrame) -> DataFrame:
    """Adds the area of a track's node as lane (null: in none); events in an area that are too far from their camera go, deletes pass."""
    joined = tracks.join(small(area_nodes), "node", "left")
    near = F.col("area").isNull() | (F.col("distance") <= F.coalesce("threshold", F.lit(float("inf"))))
    return joined.where(F.col("is_deleted") | near).drop("threshold").withColumnRenamed("area", "lane")


def listening(tracks: DataFrame, nodes: DataFrame) -> DataFrame:
    return tracks.join(small(nodes), "node", "left_semi")


def skip_assigned(tracks: DataFrame, assigned: DataFrame) -> DataFrame:
    """Events of tracklets that have no association yet; deletes pass."""
    taken = assigned.select(F.col("node").alias("__n"), F.col("track_id").alias("__t"), F.lit(True).alias("__taken")).distinct()
    joined = tracks.join(taken, (F.col("node") == F.col("__n")) & (F.col("track_id") == F.col("__t")), "left")
    return joined.where(F.col("is_deleted") | F.col("__taken").isNull()).drop("__n", "__t", "__taken")


def local_tracks(tracks: DataFrame) -> DataFrame:
    """node, track_id, x, y (null when deleted), first_ts, ts."""
    alive = lambda c: F.when(~F.col("is_deleted"), F.col(c)).alias(c)
    return tracks.select("node", "track_id", alive("x"), alive("y"), "first_ts", "ts", "seq")


def lines(tracks: DataFrame, ttl: int | None = None) -> DataFrame:
    """Pair each position with the one before it: kind point (no start), line or deleted (no stop). Starts older than `ttl` are forgotten."""
    order = Window.partitionBy("node", "track_id").orderBy("ts", "seq")
    age = F.col("ts") - F.lag("ts").over(order)
    gone = F.lit(False) if ttl is None else age >= ttl
    start = lambda c: F.when(~gone & ~F.coalesce(F.lag("is_deleted").over(order), F.lit(False)), F.lag(c).over(order))
    found = tracks.withColumns({"x0": start("x"), "y0": start("y")})
    kind = F.when(F.col("is_deleted"), "deleted").when(F.col("x0").isNull(), "point").otherwise("line")
    return found.withColumn("kind", kind)
