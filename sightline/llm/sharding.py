"""Sharding of records by rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import materialize
from sightline.operators.tables import BROADCAST_ROWS


def draw(key: Column, shard: int, seed: str = "shard") -> Column:
    """A uniform number above 0 and below 1 that only key, shard and seed decide."""
    text = F.concat(F.lit(f"{seed}:{shard}:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def bid(key: Column, shard: int, weight: float) -> Column:
    """What a shard bids for a key; over all keys a shard wins in proportion to its weight. Ties go to the lower shard."""
    chance = draw(key, shard)
    return F.struct((F.log(chance) / F.lit(float(weight))).alias("bid"), chance.alias("draw"), F.lit(-shard).alias("tie"))


def winner(bids: list[Column]) -> Column:
    return (-F.array_max(F.array(*bids))["tie"]).cast("int")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the highest bid. A shard more changes only the rows that it wins itself."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    return winner([bid(key, s, w) for s, w in enumerate(weights)])


#: Buckets that the rows of a shard are dealt to, by three digits of a hash, and copies of a row that are numbered together at most. Slots depend on both.
BUCKETS, RUN = 4096, 10_000


def number_within(df: DataFrame, group: str, groups: int, order: list[str], slot: str) -> DataFrame:
    """Number the rows of each group from 0 without a gap, in no task with a whole group. The rows alone decide the numbers.

    Rows are counted, so that a crowd of copies is one row of the shuffles, or one for each RUN of them. These are dealt to (group, bucket) by a
    hash of all columns of `order`, so that rows of one key part where anything else differs; a bucket starts where the counts of the buckets
    before it end. The counts are at most groups x BUCKETS rows.
    """
    copies = materialize(df.groupBy(*df.columns).agg(F.count("*").alias("__n")))
    parts = copies.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / RUN))))
    told = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in [*order, "__part"]])
    dealt = parts.withColumns({"__n": F.least(F.lit(RUN).cast("bigint"), F.col("__n") - F.col("__part") * RUN), "__bucket": F.substring(F.md5(told.cast("binary")), 1, 3)})
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy(group, "__bucket").agg(F.sum("__n").alias("__sum"))
    starts = counts.select(group, "__bucket", before("__sum", Window.partitionBy(group).orderBy("__bucket")).alias("__start"))
    first = F.col("__start") + before("__n", Window.partitionBy(group, "__bucket").orderBy(*order, "__part"))
    placed = dealt.join(F.broadcast(starts) if groups * BUCKETS <= BROADCAST_ROWS else starts, [group, "__bucket"]).withColumn("__first", first)
    run = F.sequence(F.col("__first").cast("long"), (F.col("__first") + F.col("__n") - 1).cast("long"))
    return placed.select(*df.columns, F.explode(run).alias(slot))


def shard_documents(docs: DataFrame, shards: int = 8, weights: list[float] | None = None, key: str = "doc_id", text: str = "text", new_weight: float = 1.0) -> DataFrame:
    """Deal documents to weighted shards by their stable key, and number the rows of each shard.

    Columns: the key, size (UTF-8 bytes plus 1), text_crc32 (unsigned), law ('key'), shard, slot (0, 1, ... within the shard),
    grown_shard (the shard if one of weight `new_weight` were added: only rows that it wins move).
    Law 'key': the key and the shards decide alone, so rows of one key, copies included, share a shard; rows of a null key do too, in as many
    buckets as their texts deal them to.
    A null text has size 1 and checksum 0, an empty table no rows; repeated rows each get a slot of their own; other columns are not read.
    Slots go by bucket (a hash of key, size and checksum), then key, size and checksum; no setting of the session changes them.
    No Python runs on the executors, and only numbers are shuffled, never texts.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards:
        raise ValueError("one weight for each shard")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    bids = [bid(F.col(key), s, w) for s, w in enumerate([*weights, new_weight])]
    dealt = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        winner(bids[:-1]).alias("shard"),
        winner(bids).alias("grown_shard"),
    )
    numbered = number_within(dealt, "shard", shards, [key, "size", "text_crc32"], "slot")
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
