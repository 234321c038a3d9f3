"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.tables import discard as discard
from sightline.operators.tables import materialize as materialize
from sightline.operators.tables import observed as observed
from sightline.operators.tables import small as small

def crc_mod(column, n: int):
    """crc32 of the value as text, modulo n (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: Bytes of text that a classifier is fitted on, at most.
SAMPLE_BYTES = 96 << 20


def sampled(rows: DataFrame, key: str, bound: int, salt: str, size: int = SAMPLE_BYTES) -> DataFrame:
    """Different rows (by key and text) with the smallest hashes, `bound` of them and `size` bytes of text at most; all of them while there are no more.

    rows: key, text and more. Copies count once. What the driver sees is a hash and a length for each chosen row.
    """
    h = F.xxhash64(F.lit(salt), F.col(key).isNull(), F.col(key), F.coalesce("text", F.lit("")))
    n, near = rows.count(), rows.withColumn("__h", h)
    if n > 2 * bound:
        near = near.where(F.col("__h") < int((2 * bound / n - 0.5) * 2**64))
    heads = near.select("__h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct().orderBy("__h").limit(bound).collect()
    cut, held = None, 0
    for r in heads:
        held += r.size
        if held > size:
            break
        cut = r["__h"]
    return near.where(F.lit(False) if cut is None else F.col("__h") <= cut).dropDuplicates(["__h"]).drop("__h")


def fields_of(schema) -> str:
    """The columns of a schema, for the schema of a result that keeps them."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def spare(columns: list[str], name: str) -> str:
    """A column name that a table has not."""
    while name in columns:
        name += "_"
    return name


def sliced(batches, rows: int = 256, size: int = 2 << 20):
    """Cut Arrow batches into slices of at most `rows` rows and, for more than one row, about `size` bytes of `text`."""
    for batch in batches:
        length = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0))
        start, held = 0, 0
        for i, n in enumerate(length):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        # What one batch took is given back before the next comes: workers live on from stage to stage.
        del batch, length
        pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: equal inputs stay equal, and the bits of unequal ones spread."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int, held={}) -> np.ndarray:
    """The first n powers of base modulo 2**64."""
    have = held.get(int(base))
    if have is None or len(have) < n:
        have = np.cumprod(np.full(max(n, 1 << 16), base, np.uint64)) * np.uint64(pow(int(base), -1, 1 << 64))
        held.clear() if len(held) > 4 else None
        held[int(base)] = have
    return have[:n]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts, as arrays.

    first, last: byte ranges; doc: row of each word; at: for each row, where its words begin (n + 1 values);
    hash: 64 bits for each word (ASCII letters in lower case if `lower`). gaps: a table of other bytes that part words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray | None = None):
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~(SPACE if gaps is None else gaps)[data]
        begins = np.zeros(n + 1, bool)
        begins[offsets[:-1]] = True
        starts = inside[1:] & (~inside[:-1] | begins)
        ends = inside[:-1] & (~inside[1:] | begins)
        self.first, self.last = np.flatnonzero(starts), np.flatnonzero(ends)
        self.at = np.searchsorted(self.first, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[data] * _powers(_STEP, n), out=total[1:])
        self._total, self._back = total, _powers(_BACK, n + 1)
        self.hash = self.ranges(self.first, self.last)

    def ranges(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self._total[last] - self._total[first]) * self._back[first] + (last - first).astype(np.uint64))


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; len(words) - n + 1 values."""
    out = words[: len(words) - n + 1] * _STEP if len(words) >= n else np.empty(0, np.uint64)
    for i in range(1, n):
        out = mix(out + np.uint64(i)) + words[i : len(words) - n + 1 + i] * _STEP
    return mix(out)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and the n + 1 offsets of the texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def grams(points: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of the hashed character n-grams of one text, for every order."""
    found, x = [], points.astype(np.uint32)
    for n in orders:
        if len(x) >= n:
            h = np.full(len(x) - n + 1, n * 0x51ED27 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h = (h ^ x[i : len(x) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            found.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def gram_counts(points: np.ndarray, orders: tuple[int, ...], bits: int, piece: int = 1 << 20) -> np.ndarray:
    """Counts by bucket over a whole text; long texts are taken in pieces that overlap by what an n-gram needs."""
    if len(points) <= piece:
        return np.bincount(grams(points, orders, bits), minlength=1 << bits)
    return sum(gram_counts(points[max(0, i - n + 1) : i + piece], (n,), bits, 2 * piece) for n in orders for i in range(0, len(points), piece))


def tree_sum(df: DataFrame, fan_in: int = 16) -> np.ndarray:
    """Sum rows of one binary column `v`, each a vector of 64-bit integers, over partitions in a tree; the driver gets a few of them."""

    def add(batches):
        total = None
        for batch in batches:
            for v in batch.column("v"):
                x = np.frombuffer(v.as_py(), np.int64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    n = df.rdd.getNumPartitions()
    while n > 2 * fan_in:
        n = -(-n // fan_in)
        df = df.repartition(n).mapInArrow(add, "v binary")
    rows = [np.frombuffer(r.v, np.int64) for r in df.collect()]
    return np.sum(rows, axis=0) if rows else np.zeros(0, np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold, bound: int, salt: str) -> DataFrame:
    """Labelled rows (doc_id, text, label) for fitting, `bound` and SAMPLE_BYTES of text at most. Of repeated labels the highest counts.

    The ids with the smallest hashes are chosen before any text is read, so that they can be broadcast.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(F.expr(fold) if isinstance(fold, str) else fold).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    if ids.count() > bound:
        ids = ids.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(bound)
    ids = ids.withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")
    return sampled(rows, "doc_id", bound, salt)
