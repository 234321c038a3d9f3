"""Tables that jobs hand on to each other."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast if it is within both bounds, its bytes as `small` reckons them; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A temporary one is set only where none is and all tasks run in this machine's one JVM."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path beside materialised tables; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    files, at = _path(spark, folder)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again. The table goes when the application ends, or by `discard`."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _path(spark, folder)
    files.deleteOnExit(at)
    found = spark.read.schema(df.schema).parquet(path)
    found.__dict__["_table"] = path
    return found


def observed(df: DataFrame, *aggregates: Column) -> tuple[DataFrame, dict]:
    """As materialize, with aggregates over the rows that are taken while they are written."""
    seen = Observation()
    return materialize(df.observe(seen, *aggregates)), seen.get


def discard(df: DataFrame | None) -> None:
    """Delete a materialised table that nothing will read again."""
    path = df.__dict__.pop("_table", None) if df is not None else None
    if path:
        files, at = _path(df.sparkSession, path)
        files.delete(at, True)


def small(df: DataFrame) -> DataFrame:
    """Mark a table for broadcast if its counted rows and bytes are within the bounds; else leave the join to shuffle.

    Bytes are 16 for each value, and the bytes of texts and binary values; other columns of varying size keep a table from being broadcast.
    """
    wide, size = [f for f in df.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")], F.lit(0)
    for f in df.schema:
        if f.dataType.typeName() in ("string", "binary", "varchar", "char"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if not wide and n <= BROADCAST_ROWS and 16 * n * len(df.columns) + held <= BROADCAST_BYTES else df
