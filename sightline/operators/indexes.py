"""Indexes of tracklets over an event log, and reads by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def track_index(log: DataFrame) -> DataFrame:
    """One row for each tracklet: first and last zone that is not null, payload and delete times, offsets and the count of events.

    A tracklet whose first event is a delete is left out; -1 stands for the end of one that is still open.
    """
    at = F.struct("ts", "seq")
    zone = F.when(F.col("zone").isNotNull(), at)
    gone = F.when(F.col("is_deleted"), F.col("ts"))
    return (
        log.groupBy("node", "track_id")
        .agg(
            F.min_by("zone", zone).alias("enter_zone"),
            F.max_by("zone", zone).alias("exit_zone"),
            F.min_by("first_ts", at).alias("first_ts"),
            F.coalesce(F.max(gone), F.lit(-1)).alias("last_ts"),
            F.min("seq").alias("first_offset"),
            F.coalesce(F.max(F.when(F.col("is_deleted"), F.col("seq"))), F.lit(-1)).alias("last_offset"),
            F.count("*").alias("count"),
            F.min_by("is_deleted", at).alias("__gone_first"),
        )
        .where(~F.col("__gone_first"))
        .drop("__gone_first")
    )


def partial_index(log: DataFrame, by: list[str]) -> DataFrame:
    """What rows of a log say of their keys, for `combined_index` to put together; `by`: the keys, and what else rows are kept apart by."""
    at = ["ts", "seq"]
    zone = F.when(F.col("zone").isNotNull(), F.struct(*at, "zone"))
    return log.groupBy(*by).agg(
        F.min(zone).alias("enter"),
        F.max(zone).alias("leave"),
        F.min(F.struct(*at, "first_ts", "is_deleted")).alias("first"),
        F.max(F.when(F.col("is_deleted"), F.col("ts"))).alias("gone_ts"),
        F.max(F.when(F.col("is_deleted"), F.col("seq"))).alias("gone_offset"),
        F.min("seq").alias("first_offset"),
        F.max("seq").alias("newest_offset"),
        F.count("*").alias("count"),
    )


def combined_index(partials: DataFrame, keys: list[str]) -> DataFrame:
    """The index (see track_index) of logs of which `partial_index` tells, in whatever parts they were told."""
    found = partials.groupBy(*keys).agg(
        F.min("enter").alias("enter"), F.max("leave").alias("leave"), F.min("first").alias("first"), F.coalesce(F.max("gone_ts"), F.lit(-1)).alias("last_ts"), F.min("first_offset").alias("first_offset"), F.coalesce(F.max("gone_offset"), F.lit(-1)).alias("last_offset"), F.sum("count").alias("count")
    )
    named = [F.col("enter.zone").alias("enter_zone"), F.col("leave.zone").alias("exit_zone"), F.col("first.first_ts").alias("first_ts")]
    return found.where("not first.is_deleted").select(*keys, *named, "last_ts", "first_offset", "last_offset", "count")


def update_index(log: DataFrame, key: str, closed_only: bool = True, alive_since: int | None = None) -> DataFrame:
    """One row for each key of an update log, once it is closed; or, if not closed_only, with -1 for ends that are open.

    Keys that are open and have had no event since `alive_since` are purged.
    """
    at = F.struct("ts", "seq")
    found = log.groupBy(key).agg(
        F.min("seq").alias("first_offset"),
        F.max("seq").alias("last_offset"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("count"),
        F.bool_or("is_deleted").alias("__closed"),
        F.min_by("is_deleted", at).alias("__gone_first"),
    )
    found = found.where(~F.col("__gone_first")).drop("__gone_first")
    if alive_since is not None:
        found = found.where(F.col("__closed") | (F.col("last_ts") >= alive_since))
    if closed_only:
        return found.where("__closed").drop("__closed")
    end = lambda c: F.when(F.col("__closed"), F.col(c)).otherwise(F.lit(-1)).alias(c)
    return found.select(key, "first_offset", end("last_offset"), "first_ts", end("last_ts"), "count")


def oldest_open(index: DataFrame) -> DataFrame:
    """The offset that a restart must read from: the smallest first offset of tracklets that are open."""
    return index.where("last_ts = -1").agg(F.min("first_offset").alias("offset"))


def overlaps(first: Column, last: Column, low: int | None, high: int | None) -> Column:
    """Index rows that overlap an interval, either end of which may be open."""
    if low is None and high is None:
        return F.lit(True)
    if low is None:
        return last <= high
    if high is None:
        return first >= low
    return (first < high) & (last >= low)


def replay(log: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Events of indexed tracklets, from their first to their last offset (to the end if that is open)."""
    bounds = index.select(*keys, F.col("first_offset").alias("__a"), F.col("last_offset").alias("__b"))
    found = log.join(bounds, keys).where((F.col("seq") >= F.col("__a")) & ((F.col("__b") < 0) | (F.col("seq") <= F.col("__b"))))
    return found.drop("__a", "__b")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key of two tables."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(*keys, "r.*")
