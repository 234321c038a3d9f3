"""Event logs: the wire form of records, and batch and streaming reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_TRACK = "node string, track_id string, state string, bbox array<double>, location array<double>, distance double, zone_expr string, first_ts bigint, frame_index bigint, ts bigint"
GLOBAL_TRACK = "id string, state string, location array<double>, supports array<struct<node: string, track_id: string, location: array<double>, first_ts: bigint, ts: bigint>>, first_ts bigint, ts bigint"


def decode(values: DataFrame, schema: str = NODE_TRACK, value: str = "value") -> DataFrame:
    """Records from JSON text in a column; the others stay. Text that is not JSON gives nulls."""
    return values.withColumn("__r", F.from_json(F.col(value).cast("string"), schema)).select(*[c for c in values.columns if c != value], "__r.*")


def encode(df: DataFrame, key: Column) -> DataFrame:
    """key and value, the value as JSON with all columns."""
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def as_tracks(records: DataFrame) -> DataFrame:
    """Node tracks as operators read them: x, y, zone and is_deleted besides their own columns."""
    zone = F.nullif(F.regexp_extract("zone_expr", r"^.\((.*)\)$", 1), F.lit(""))
    return records.withColumns({"x": F.get("location", F.lit(0)), "y": F.get("location", F.lit(1)), "zone": zone, "is_deleted": F.col("state") == "Deleted"})


def read_log(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A bounded read; first and last bound the offsets (column seq), last included."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("seq") >= first)
    return df if last is None else df.where(F.col("seq") <= last)


def stream_log(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """An unbounded read of files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def from_topics(spark: SparkSession, servers: str, topics: str, streaming: bool = True, schema: str = NODE_TRACK) -> DataFrame:
    """Records of topics, with partition and offset (as seq). Needs Spark's Kafka package on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    return decode(reader.load().select("value", "partition", F.col("offset").alias("seq")), schema)
