"""Logs that lie in blocks of offsets, with an index of what each block holds, so that a replay reads those blocks alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import indexes
from sightline.operators.tables import _path, small

#: Where a batch, a part (the topic partition that an event came from) and a block of offsets lie.
PLACE = ["batch", "part", "block"]
#: Blocks that a replay names one by one; for more than these the whole log is read, and the join with the index leaves what isn't wanted.
PATHS = 10_000


class BlockLog:
    """A log under a folder: `events`, in folders by batch, part and block of `size` offsets, and `index`, a row for each key and block.

    Columns of events: the keys, `seq` (offset), `part` where offsets are those of parts (else all are of part 0), and others. A block has at most `size`
    events, as offsets are not repeated, and is one task's when it is written. With `tracks`, an index row is a partial state of the track index, too,
    so the index of tracklets comes from these rows and no event is read; events then need ts, zone, first_ts and is_deleted.

    A batch writes its events, then its index; readers look at batches alone whose index is whole, and a batch that comes again writes the same
    folders. So a job that dies in between changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...] = ("node", "track_id"), size: int = 1 << 22, tracks: bool = True):
        self.spark, self.folder, self.keys, self.size, self.tracks = spark, folder.rstrip("/"), list(keys), size, tracks

    def put(self, batch: int, events: DataFrame) -> None:
        """Write rows as batch number `batch`. Rows without an offset have no place in a log and are refused; a null part is part -1."""
        if clash := {"batch", "block"} & set(events.columns):
            raise ValueError(f"columns {sorted(clash)} are the log's own")
        part = F.col("part").cast("long") if "part" in events.columns else F.lit(0).cast("long")
        offset = F.when(F.col("seq").isNull(), F.raise_error(F.lit("an event has no offset"))).otherwise(F.col("seq"))
        placed = events.withColumns({"seq": offset, "part": F.coalesce(part, F.lit(-1).cast("long")), "block": F.floor(F.col("seq") / self.size)})
        # Within a block keys lie together, so that statistics of row groups tell apart what a replay wants.
        dealt = placed.repartition("part", "block").sortWithinPartitions("part", "block", *self.keys, "seq")
        dealt.write.mode("overwrite").partitionBy("part", "block").parquet(self._events(batch))
        written = self.spark.read.schema(placed.schema).parquet(self._events(batch))
        by = [*self.keys, "part", "block"]
        if self.tracks:
            found = indexes.partial_index(written, by)
        else:
            found = written.groupBy(*by).agg(F.min("seq").alias("first_offset"), F.max("seq").alias("newest_offset"), F.count("*").alias("count"))
        found.write.mode("overwrite").parquet(self._index(batch))

    def follow(self, stream: DataFrame, checkpoint: str):
        """Put a stream, batch by batch; the batch's number is the stream's."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.put(number, rows)).option("checkpointLocation", checkpoint)

    def _events(self, batch: int) -> str:
        return f"{self.folder}/events/batch={batch}"

    def _index(self, batch: int) -> str:
        return f"{self.folder}/index/batch={batch}"

    def batches(self) -> list[int]:
        """Batches that are whole."""
        files, at = _path(self.spark, f"{self.folder}/index")
        found = [f.getPath() for f in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(p.getName().partition("=")[2]) for p in found if files.exists(_path(self.spark, f"{p}/_SUCCESS")[1]))

    def index(self) -> DataFrame:
        """A row for each key and block: where its events lie."""
        done = self.batches()
        if not done:
            raise ValueError(f"{self.folder} holds no whole batch")
        return self.spark.read.option("basePath", f"{self.folder}/index").parquet(*map(self._index, done)).withColumn("batch", F.col("batch").cast("long"))

    def track_index(self) -> DataFrame:
        """As `indexes.track_index` of all events, from the rows of `index`."""
        return indexes.combined_index(self.index(), self.keys)

    def events(self, places: DataFrame | None = None) -> DataFrame:
        """Events of whole batches; with `places` (batch, part, block), of those blocks alone, and nothing else is listed or opened.

        The driver sees the names of blocks, PATHS of them at most. Beyond that all blocks are read, and only rows of the places stay.
        """
        reader = self.spark.read.option("basePath", f"{self.folder}/events")
        whole = [self._events(b) for b in self.batches()]
        if places is None:
            return reader.parquet(*whole)
        named = places.select(*PLACE).distinct()
        few = named.limit(PATHS + 1).collect()
        if len(few) > PATHS:
            return reader.parquet(*whole).join(small(named), PLACE, "left_semi")
        if not few:
            return reader.parquet(*whole).where(F.lit(False))
        return reader.parquet(*sorted(f"{self._events(r.batch)}/part={r.part}/block={r.block}" for r in few))

    def between(self, first: int | None = None, last: int | None = None, part: int | None = None) -> DataFrame:
        """Events from one offset to another, both included; the blocks outside are not opened."""
        seq, block = F.col("seq"), F.col("block")
        found = self.events()
        if part is not None:
            found = found.where(F.col("part") == part)
        if first is not None:
            found = found.where((block >= first // self.size) & (seq >= first))
        return found if last is None else found.where((block <= last // self.size) & (seq <= last))

    def places(self, wanted: DataFrame) -> DataFrame:
        """Rows of the index for some keys; with first_offset and last_offset (-1: to the end) in `wanted`, those alone that meet these bounds."""
        rows = self.index().select(*self.keys, *PLACE, F.col("first_offset").alias("__low"), F.col("newest_offset").alias("__high"))
        return rows.join(small(self._bounds(wanted)), self.keys).where((F.col("__high") >= F.col("__a")) & (F.col("__low") <= F.col("__b")))

    def replay(self, wanted: DataFrame) -> DataFrame:
        """Events of some keys, each once; with first_offset and last_offset (-1: to the end), from the one to the other. Null keys are not found."""
        found = self.events(self.places(wanted)).join(small(self._bounds(wanted)), self.keys)
        return found.where((F.col("seq") >= F.col("__a")) & (F.col("seq") <= F.col("__b"))).drop("__a", "__b", "batch", "block")

    def _bounds(self, wanted: DataFrame) -> DataFrame:
        least, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
        if "first_offset" not in wanted.columns:
            return wanted.select(*self.keys).distinct().select(*self.keys, least.alias("__a"), most.alias("__b"))
        last = F.when(F.col("last_offset") < 0, most).otherwise(F.col("last_offset"))
        return wanted.select(*self.keys, F.col("first_offset").alias("__a"), last.alias("__b")).distinct()
