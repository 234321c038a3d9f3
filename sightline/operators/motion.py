"""Association of tracklets that move together in overlapping views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry, ids
from sightline.operators import blocks, tracks, windows
from sightline.operators.tables import small


def window_paths(gated: DataFrame, size: int, advance: int) -> DataFrame:
    """One path for each tracklet, area and window: points in order of time."""
    placed = windows.hopping(gated.where(~F.col("is_deleted")), size, advance)
    point = F.struct("ts", "seq", "x", "y")
    return placed.groupBy("area", "w_begin", "node", "track_id").agg(F.array_sort(F.collect_list(point)).alias("path"), F.min_by("first_ts", F.struct("ts", "seq")).alias("first_ts"), F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).alias("box"))


def path_pairs(paths: DataFrame, area_pairs: DataFrame) -> DataFrame:
    """Paths of two bound nodes in one area and window. The node pair is joined first, so both joins are on equal keys alone."""
    side = lambda s: paths.select("area", "w_begin", F.col("node").alias(f"{s}_node"), ids.tracklet_id(F.col("node"), F.col("track_id")).alias(f"{s}_id"), F.col("path").alias(f"{s}_path"), F.col("first_ts").alias(f"{s}_first"), F.col("box").alias(f"{s}_box"))
    left = side("left").join(small(area_pairs.select("area", F.col("node1").alias("left_node"), F.col("node2").alias("right_node"))), ["area", "left_node"])
    return left.join(side("right"), ["area", "w_begin", "right_node"]).where((F.col("left_node") != F.col("right_node")) | (ids.tracklet_order(F.col("left_id")) < ids.tracklet_order(F.col("right_id"))))


def scored_pairs(pairs: DataFrame, most: float) -> DataFrame:
    """Pairs whose best alignment is closer than `most`: score, and the times of the closest points of that alignment."""
    left_longer = F.size("left_path") >= F.size("right_path")
    apart = lambda c: F.greatest(F.lit(0.0), F.col(f"left_box.{c}0") - F.col(f"right_box.{c}1"), F.col(f"right_box.{c}0") - F.col(f"left_box.{c}1"))
    # Points of paths whose boxes are `most` apart are, too; a little more is let pass, as distances are rounded.
    pairs = pairs.where(F.pow(apart("x"), 2.0) + F.pow(apart("y"), 2.0) < (most + 1e-3) ** 2)
    shaped = pairs.withColumns({"longer": F.when(left_longer, F.col("left_path")).otherwise(F.col("right_path")), "shorter": F.when(left_longer, F.col("right_path")).otherwise(F.col("left_path"))})
    aligned = shaped.withColumn("best", geometry.path_alignment(F.col("longer"), F.col("shorter"))).where(F.col("best.d") < most)
    close = aligned.withColumn("at", geometry.closest_points(F.col("longer"), F.col("shorter"), F.col("best.o")))
    long_ts, short_ts = F.get("longer", F.col("best.o") + F.col("at.i"))["ts"], F.get("shorter", F.col("at.i"))["ts"]
    return close.select(
        "area",
        "w_begin",
        "left_id",
        "right_id",
        F.round(1 - F.col("best.d") / most, 9).alias("score"),
        F.when(left_longer, long_ts).otherwise(short_ts).alias("left_ts"),
        F.when(left_longer, short_ts).otherwise(long_ts).alias("right_ts"),
        ids.edge_leader(F.col("left_id"), F.col("left_first"), F.col("right_id"), F.col("right_first")).alias("id"),
        F.least("left_first", "right_first").alias("first_ts"),
    )


def best_edges(edges: DataFrame) -> DataFrame:
    """The best edge of each pair; of equal scores the one of the earliest window."""
    rest = ["id", "left_ts", "right_ts", "first_ts", "w_begin"]
    found = edges.groupBy("left_id", "right_id").agg(F.max_by(F.struct("score", *rest), F.struct("score", (-F.col("w_begin")).alias("w"))).alias("e"))
    return found.select("left_id", "right_id", "e.*")


def motion_edges(events: DataFrame, area_nodes: DataFrame, area_pairs: DataFrame, size: int, advance: int, most: float, keep: str = "best", **only) -> DataFrame:
    """Gate by distance, cut into hopping windows, pair tracklets of bound nodes, score paths and keep each pair's best edge, or what else `keep` says
    (see blocks.pair_blocks, which pairs without a row for each pair of paths; the functions above are the same for other uses)."""
    gated = tracks.distance_gate(events, area_nodes).where("area is not null")
    return blocks.pair_blocks(gated, area_pairs, size, advance, most, keep, **only)
