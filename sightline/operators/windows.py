"""Event-time windows over epoch milliseconds."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hopping(df: DataFrame, size: int, advance: int | None = None, ts: str = "ts", begin: str = "w_begin", anchor: str = "epoch", by: list[str] | None = None) -> DataFrame:
    """One row for each half-open window [begin, begin + size) that holds the event.

    anchor `epoch` starts windows at multiples of `advance`; `first_event` at the first event (of each group in `by`), and none before it.
    """
    advance = advance or size
    start = F.lit(0)
    if anchor == "first_event":
        first = df.groupBy(*(by or [])).agg(F.min(ts).alias("__start"))
        df = df.join(first, by) if by else df.crossJoin(F.broadcast(first))
        start = F.col("__start")
    newest = F.floor((F.col(ts) - start) / advance) * advance + start
    steps = F.sequence(F.lit(0), F.lit(math.ceil(size / advance) - 1))
    found = df.withColumn(begin, F.explode(F.transform(steps, lambda i: (newest - i * advance).cast("bigint"))))
    found = found.where(F.col(ts) < F.col(begin) + size)
    return found.where(F.col(begin) >= F.col("__start")).drop("__start") if anchor == "first_event" else found


def newest_only(df: DataFrame, advance: int, deleted: str = "is_deleted", ts: str = "ts", begin: str = "w_begin") -> DataFrame:
    """Of a delete in overlapping windows, only the one in the newest window stays."""
    return df.where(~F.col(deleted) | (F.col(ts) - F.col(begin) < advance))


def number_in_order(df: DataFrame, by: str, order: list, ts: str = "ts", out: str = "place", bucket: int = 86_400_000) -> DataFrame:
    """Number the rows of each group from 1 in order of `ts`, then `order`: within buckets of time, after the counts of earlier buckets, so that no
    group is one task's. Counts are one row for each group and bucket."""
    dealt = df.withColumn("__b", F.floor(F.col(ts) / bucket))
    counts = dealt.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(by, "__b").orderBy(ts, *order))
    return dealt.withColumn("__own", own).join(counts.select(by, "__b", earlier.alias("__before")), [by, "__b"]).withColumn(out, (F.col("__before") + F.col("__own")).cast("long")).drop("__b", "__own", "__before")


def next_at_least(df: DataFrame, by: str, ahead: int, ts: str = "ts", out: str = "next_ts", bucket: int = 3_600_000) -> DataFrame:
    """For each event the time of the first event of its group that is `ahead` or more after it; null if there is none.

    An as-of join without pairs: events, and the times that are looked for, are ordered within (group, bucket of time), where the next event is a running
    minimum from the end; what a bucket lacks comes from the first event of the buckets behind it, a row for each bucket. No group is one task's.
    """
    events = df.select(F.col(by).alias("__by"), F.col(ts).alias("__at"), F.col(ts).alias("__event"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema) + ">").alias("__row"))
    probes = df.select(F.col(by).alias("__by"), (F.col(ts) + ahead).alias("__at"), F.lit(None).cast("bigint").alias("__event"), F.struct(*df.columns).alias("__row"))
    dealt = events.unionByName(probes).withColumn("__b", F.floor(F.col("__at") / bucket))
    # From the end on; an event at the very time that is looked for comes first.
    order = Window.partitionBy("__by", "__b").orderBy(F.desc("__at"), F.desc_nulls_last("__event")).rowsBetween(Window.unboundedPreceding, 0)
    firsts = dealt.groupBy("__by", "__b").agg(F.min("__event").alias("__first"))
    behind = Window.partitionBy("__by").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    later = firsts.select(F.col("__by").alias("__of"), F.col("__b").alias("__in"), F.min("__first").over(behind).alias("__later"))
    found = dealt.withColumn("__near", F.min("__event").over(order)).where("__row is not null")
    joined = found.join(later, F.col("__by").eqNullSafe(F.col("__of")) & (F.col("__b") == F.col("__in")))
    return joined.select("__row.*", F.coalesce("__near", "__later").alias(out))


def reanchored(df: DataFrame, size: int, advance: int, by: list[str], ts: str = "ts", begin: str = "w_begin") -> DataFrame:
    """Windows whose phase starts anew whenever an event comes after all open windows have closed. Groups of `by` are walked in order of time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {begin} bigint"

    def walk(group):
        group = group.sort_values(ts, kind="stable")
        rows, open_at = [], []
        for i, t in enumerate(group[ts]):
            open_at = [b for b in open_at if t < b + size]
            if not open_at:
                open_at = [t]
            while open_at[-1] + advance <= t:
                open_at.append(open_at[-1] + advance)
            rows += [(i, b) for b in open_at if b <= t < b + size]
        out = group.iloc[[i for i, _ in rows]].copy()
        out[begin] = [b for _, b in rows]
        return out

    return df.groupBy(*by).applyInPandas(walk, schema)


def after_silence(df: DataFrame, by: list[str], gap: int, ts: str = "ts", out: str = "since", bucket: int = 3_600_000) -> DataFrame:
    """For each event the time of the last event of its group, itself included, before which the group was silent for `gap`, or had not begun.

    Running values are taken within (group, bucket of time); what a bucket needs from those before it is one row a bucket. Null keys are a group.
    """
    dealt = df.withColumn("__b", F.floor(F.col(ts) / bucket))
    within, earlier = Window.partitionBy(*by, "__b").orderBy(ts), Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, value, name: str) -> DataFrame:
        """Add the greatest value of the earlier buckets of the group."""
        told = rows.groupBy(*by, "__b").agg(F.max(value).alias("__v"))
        told = told.select(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate([*by, "__b"])], F.max("__v").over(earlier).alias(name))
        same = F.lit(True)
        for i, c in enumerate([*by, "__b"]):
            same = same & rows[c].eqNullSafe(told[f"__of_{i}"])
        return rows.join(told, same).select(*rows.columns, name)

    seen = carried(dealt, F.col(ts), "__prior")
    before = F.coalesce(F.lag(ts).over(within), F.col("__prior"))
    marked = seen.withColumn("__start", F.when(before.isNull() | (F.col(ts) - before >= gap), F.col(ts))).drop("__prior")
    own = F.max("__start").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return carried(marked, F.col("__start"), "__former").select(*df.columns, F.coalesce(own, "__former").alias(out))


def arrival_spans(df: DataFrame, span: int, by: list[str], ts: str = "ts", begin: str = "w_begin", bucket: int = 3_600_000) -> DataFrame:
    """Each event with the time of the first event of its span: a span holds all that comes less than `span` after its first event, and the next event
    starts another one. Events of a group come in order of `ts`; those without a time are in no span and go.

    Where a group was silent for `span` a new one begins whatever came before, so the log is cut there, and the pieces are dealt among tasks;
    each is walked in order, with one time as the walk's memory.
    """
    cut = after_silence(df.where(F.col(ts).isNotNull()), by, span, ts, "__since", bucket)
    cut = cut.withColumn("__piece", F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], "__since"))).drop("__since")
    kept = [c for c in df.columns]

    def walk(batches):
        piece, first = None, 0
        for batch in batches:
            found = []
            for name, at in zip(batch.column("__piece").to_pylist(), batch.column(ts).to_pylist()):
                if name != piece or at >= first + span:
                    piece, first = name, at
                found.append(first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.int64())], [*kept, begin])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{begin}` bigint"
    return cut.repartition("__piece").sortWithinPartitions("__piece", ts).mapInArrow(walk, schema)
