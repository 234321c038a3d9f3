
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A small site of four cameras in one area, one camera outside, five zones.
AREA_NODES = [("hall", "cam:01", 80.0), ("hall", "cam:02", 90.0), ("hall", "cam:03", 70.0), ("hall", "cam:04", None)]
AREA_PAIRS = [("hall", "cam:01", "cam:02"), ("hall", "cam:02", "cam:03"), ("hall", "cam:03", "cam:04")]
BOXES = [("A", 10.0, 40.0, 10.0, 40.0), ("B", 50.0, 90.0, 10.0, 60.0), ("C", 10.0, 40.0, 50.0, 90.0), ("D", 100.0, 200.0, 20.0, 80.0), ("E", 50.0, 90.0, 70.0, 95.0)]
LINKS = [("cam:02", "click", "cam:01", "view", 60_000, 86_400_000), ("cam:03", "view", "cam:02", "click", 0, 172_800_000), ("cam:01", "signup", "cam:03", "purchase", 3_600_000, 432_000_000)]


class Tables:
    """Tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def node_tracks(self) -> DataFrame:
        """Events as a track log; the last event of a user is its delete. Times are taken from the wall clock, whatever the session's zone."""
        return self._tracks(self.read("events"))

    def tracks_of(self, users: list[int]) -> DataFrame:
        """The part of the log that is about some users: the filter is on the stored number, so that it reaches the scan."""
        return self._tracks(self.read("events").where(F.col("user_id").isin(users)))

    def _tracks(self, e: DataFrame) -> DataFrame:
        ms = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("bigint") * 86_400_000 + F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.floor(F.expr("extract(second from ts)") * 1000)
        rows = e.select(
            F.concat(F.lit("cam:"), F.lpad((F.col("user_id") % 5 + 1).cast("string"), 2, "0")).alias("node"),
            F.col("user_id").cast("string").alias("track_id"),
            ms.cast("bigint").alias("ts"),
            F.col("event_id").alias("seq"),
            F.col("value").alias("x"),
            F.get_json_object("props", "$.k").cast("double").alias("y"),
            F.col("value").alias("distance"),
            F.when(F.col("event_type") != "error", F.col("event_type")).alias("zone"),
        )
        whole = Window.partitionBy("track_id")
        last = F.row_number().over(whole.orderBy(F.desc("ts"), F.desc("seq"))) == 1
        return rows.withColumns({"first_ts": F.min("ts").over(whole), "is_deleted": last})

    @cached_property
    def area_nodes(self) -> DataFrame:
        return self.spark.createDataFrame(AREA_NODES, "area string, node string, threshold double")

    @cached_property
    def area_pairs(self) -> DataFrame:
        return self.spark.createDataFrame(AREA_PAIRS, "area string, node1 string, node2 string")

    @cached_property
    def zones(self) -> DataFrame:
        ring = lambda x0, x1, y0, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return self.spark.createDataFrame([(z, ring(*b)) for z, *b in BOXES], "zone string, ring array<struct<x: double, y: double>>")

    @cached_property
    def links(self) -> DataFrame:
        return self.spark.createDataFrame(LINKS, "enter_node string, enter_zone string, exit_node string, exit_zone string, min_ms bigint, max_ms bigint")

    @cached_property
    def track_features(self) -> DataFrame:
        """Embeddings as appearance vectors, five for each tracklet; three nodes in turn."""
        v = self.read("embeddings")
        track = F.floor(F.col("vec_id") / 5)
        return v.select(track.alias("track"), F.concat(F.lit("cam:0"), (track % 3 + 1).cast("string")).alias("node"), F.col("embedding").alias("feature"), (F.col("vec_id") * 100).alias("ts"), F.col("vec_id").alias("seq"))


#: The same views for DuckDB.
SQL_TRACKS = """e0 as (
  select 'cam:' || lpad(cast(1 + user_id % 5 as varchar), 2, '0') as node, cast(user_id as varchar) as track_id, epoch_us(ts) // 1000 as ts,
    event_id as seq, value as x, cast(regexp_extract(props, '([0-9]+)', 1) as double) as y, value as distance,
    case when event_type <> 'error' then event_type end as zone
  from events
), node_tracks as (
  select *, min(ts) over (partition by track_id) as first_ts,
    row_number() over (partition by track_id order by ts desc, seq desc) = 1 as is_deleted
  from e0
)"""
_value = lambda v: "cast(null as double)" if v is None else repr(v)
SQL_AREAS = (
    "area_nodes(area, node, threshold) as (values " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in AREA_NODES) + "), area_pairs(area, node1, node2) as (values " + ", ".join(map(repr, AREA_PAIRS)) + ")"
)
SQL_ZONES = "zones(zone, x0, x1, y0, y1) as (values " + ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else f"{v}::double" for v in r) + ")" for r in BOXES) + ")"
SQL_LINKS = "links(enter_node, enter_zone, exit_node, exit_zone, min_ms, max_ms) as (values " + ", ".join(map(repr, LINKS)) + ")"
SQL_FEATURES = """track_features as (
  select vec_id // 5 as track, 'cam:0' || cast(vec_id // 5 % 3 + 1 as varchar) as node, embedding as feature, vec_id * 100 as ts, vec_id as seq from embeddings
)"""
