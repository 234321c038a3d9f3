"""Command line: build indexes, associations, global tracks and trajectories from a log of node tracks, as tables of Parquet files.

    python -m sightline.plans.commands build associations --log LOG --areas areas.yml --out OUT
    python -m sightline.plans.commands build associations --log LOG --areas areas.yml --features FEATURES --links links.yml --out OUT
    python -m sightline.plans.commands build zone_events --log LOG --zones zones.yml --out OUT
    python -m sightline.plans.commands build blocks --log LOG --out BLOCKS
    python -m sightline.plans.commands replay blocks --log BLOCKS --tracklets "cam:01[7] cam:02[9]" --out OUT
    python -m sightline.plans.commands format node_tracks_index --out OUT
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import ids
from sightline.operators import associations, feature, global_tracks, indexes, motion, stores, tracks, zones
from sightline.operators.tables import materialize
from sightline.sources import blocks, config, logs

TABLES = {
    "node_tracks_index": "node string, track_id string, enter_zone string, exit_zone string, first_ts bigint, last_ts bigint, first_offset bigint, last_offset bigint, count bigint",
    "track_features_index": "key string, first_offset bigint, last_offset bigint, first_ts bigint, last_ts bigint, count bigint",
    "associations": "id string, tracklets string, size int, score double, first_ts bigint, ts bigint",
}


def tracks_of(spark: SparkSession, path: str) -> DataFrame:
    return logs.as_tracks(logs.read_log(spark, path)).withColumn("tracklet", ids.tracklet_id(F.col("node"), F.col("track_id")))


def appearance_edges(spark: SparkSession, log: DataFrame, options: argparse.Namespace, settings: config.Feature) -> DataFrame:
    """Edges between tracklets and those that left a linked zone before them, by appearance: the best match of each that scores enough."""
    index = materialize(indexes.track_index(log).withColumn("track", ids.tracklet_id(F.col("node"), F.col("track_id"))))
    links = config.links(spark, Path(options.links).read_text())
    width = max(1, links.agg(F.max(F.col("max_ms") - F.col("min_ms"))).first()[0] or 1)
    pairs = materialize(feature.transition_candidates(index.withColumnRenamed("track", "session"), links, index, width))
    seen = spark.read.parquet(options.features).withColumn("track", ids.tracklet_id(F.col("node"), F.col("track_id")))
    scored = feature.pair_scores(pairs.select("session", "candidate"), feature.session_features(seen), settings.share).join(pairs, ["session", "candidate"])
    best = feature.best_candidates(scored)
    first = lambda s: index.select(F.col("track").alias(s), F.col("first_ts").alias(f"{s}_first"))
    matches = best.drop("first_ts").join(first("session"), "session").join(first("candidate"), "candidate")
    told = matches.select(F.col("session").alias("session_id"), F.col("candidate").alias("candidate_id"), F.col("boosted").alias("score"), "session_ts", "candidate_ts", "session_first", "candidate_first")
    return stores.match_edges(told, settings.least_score)


def build(spark: SparkSession, what: str, options: argparse.Namespace) -> DataFrame:
    log = tracks_of(spark, options.log)
    if what == "node_tracks_index":
        return indexes.track_index(log)
    if what == "track_features_index":
        return indexes.update_index(log.withColumnRenamed("tracklet", "key"), "key")
    if what == "trajectories":
        return global_tracks.trajectories(log, "tracklet", F.col("x"), F.col("y"))
    if what.startswith("zone_"):
        events = zones.zone_events(tracks.lines(log), config.zones(spark, Path(options.zones).read_text()))
        return zones.with_exits(events) if what == "zone_events" else zones.zone_residents(zones.stays(events))
    settings = config.load(Path(options.config).read_text() if options.config else "")
    nodes, pairs = config.areas(spark, Path(options.areas).read_text())
    m = settings.motion
    edges = motion.motion_edges(log, nodes, pairs, m.window, m.advance, m.most)
    if options.features:
        seen = appearance_edges(spark, log, options, settings.feature)
        edges = edges.select(*seen.columns).unionByName(seen)
    best = associations.best_associations(edges)
    if what == "associations":
        return best
    assigned = best.select(F.explode(F.split("tracklets", "-")).alias("tracklet"), F.col("id").alias("association"), "first_ts")
    enriched = global_tracks.enrich(log, assigned)
    return global_tracks.global_tracks(enriched, settings.output.interval)


def replay(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Events of some tracklets from a log in blocks; names that are no tracklet's find nothing."""
    names = [n.rpartition("[") for n in options.tracklets.split()]
    wanted = spark.createDataFrame([(node, track.removesuffix("]")) for node, _, track in names], "node string, track_id string")
    return blocks.BlockLog(spark, options.log).replay(wanted)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("action", choices=["build", "replay", "format"])
    parser.add_argument("what", choices=[*TABLES, "global_tracks", "trajectories", "zone_events", "zone_residents", "blocks"])
    parser.add_argument("--log", help="node tracks as Parquet, with the offset of each record as seq")
    parser.add_argument("--areas", help="YAML of overlapping areas")
    parser.add_argument("--features", help="appearance vectors as Parquet: node, track_id, feature, ts, seq; with --links, matches join the associations")
    parser.add_argument("--links", help="YAML of the transitions between cameras")
    parser.add_argument("--zones", help="YAML of zones")
    parser.add_argument("--tracklets", default="", help="tracklets to replay, parted by blanks")
    parser.add_argument("--batch", type=int, default=0, help="number of the batch that is put into a log in blocks; one that is there already is replaced")
    parser.add_argument("--config", help="YAML of settings")
    parser.add_argument("--out", required=True, help="folder of the table")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("sightline").getOrCreate()
    if options.action == "replay":
        replay(spark, options).write.mode("overwrite").parquet(options.out)
    elif options.action == "build" and options.what == "blocks":
        blocks.BlockLog(spark, options.out).put(options.batch, tracks_of(spark, options.log))
    elif options.action == "format":
        spark.createDataFrame([], TABLES[options.what]).write.mode("overwrite").parquet(options.out)
    else:
        build(spark, options.what, options).write.mode("overwrite").parquet(options.out)


if __name__ == "__main__":
    main()
