"""Packing of documents into token sequences of one length."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.bpe import tools
from sightline.llm.common import fields_of, observed, sliced

#: Tokens of a sequence, and the token that ends a document.
CAPACITY, END = 2048, 0
#: Pieces that are packed together, at least: what a task leaves open is a few sequences, so that many pieces make it a small share.
TOGETHER = 1 << 14
#: Encoded pieces of text that a worker keeps: some 120 MB. Packing holds little else.
CACHE = 600_000
#: Bits of a sequence's number within its task.
OWN = 40


class Packer:
    """Sequences that still have room, by how much, and the places that pieces take in them.

    A piece goes where the sum, over all gaps, of the squared counts of open sequences with that gap becomes smallest; of equals where the smallest
    gap is left. A new sequence is begun where a piece fits into none. State is a number for each open sequence and a count for each gap.
    """

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.made = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[array] = [array("q") for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The sequence of a piece, and its offset there."""
        n = self.capacity
        # A sequence leaves the count of its gap and joins that of what is left; one that is full joins none.
        change = 2 * (self.counts[: n - length + 1] - self.counts[length:]) + 2
        change[0] = 1 - 2 * self.counts[length]
        change[self.counts[length:] == 0] = np.iinfo(np.int64).max
        gap = length + int(change.argmin())
        if self.open[gap]:
            self.counts[gap] -= 1
            at = self.open[gap].pop()
        else:
            gap, at = n, self.made
            self.made += 1
        if gap > length:
            self.counts[gap - length] += 1
            self.open[gap - length].append(at)
        return at, n - gap


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns, then sequence_id and offset: each piece's place in as few sequences of `capacity` tokens as can be.

    pieces: `length` (1 to capacity) and more; they are written once. Tasks pack on their own, the long pieces first; nothing is dealt by a key, so no
    row is hot, and each task has TOGETHER pieces or more, but for the last ones of a table. Places depend on the written rows alone, so a task that is
    run again gives them again. Equal pieces are all placed. An empty table gives no rows. Input columns of the new names are replaced.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    written, seen = observed(pieces.select(*keep), F.count(F.lit(1)).alias("n"))
    order = [F.desc("length"), *(c for c, kind in written.dtypes if c != "length" and not kind.startswith(("map", "variant")))]
    dealt = written.coalesce(max(1, seen["n"] // TOGETHER)).sortWithinPartitions(*order)

    def placed(batches):
        packer, first = Packer(capacity), TaskContext.get().partitionId() << OWN
        for batch in batches:
            places = [packer.place(n) for n in batch.column("length").to_pylist()]
            columns = [pa.array([first + s for s, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*keep, "sequence_id", "offset"])

    return dealt.mapInArrow(placed, f"{fields_of(written.schema)}, sequence_id bigint, offset bigint")


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Every document's tokens, then END, cut into pieces of `capacity`: doc_id, piece (from 0), start (tokens before it), length, ids_crc32 (of the
    ids as little-endian 32-bit integers), and `ids` themselves if asked for. The last piece of a document may be shorter.

    path: a tokenizer file that each worker can read. Null and empty texts are END alone. Repeated rows and ids are documents of their own.
    """
    chosen = docs.select("doc_id", "text")
    doc_type = fields_of(chosen.schema).rpartition(", ")[0]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def cut(batches):
        encoder, _ = tools(path, CACHE)
        for batch in sliced(batches):
            row, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = b"".join(encoder.encode(text or "")) + END.to_bytes(4, "little")
                for p, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(k)
                    found.append((p, at // 4, len(part) // 4, zlib.crc32(part), part))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *columns][: len(names)], names)

    return chosen.mapInArrow(cut, f"{doc_type}, piece int, start bigint, length bigint, ids_crc32 bigint{', ids binary' if ids else ''}")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """The pieces of all documents (see token_pieces) with their places in sequences (see pack). Only documents longer than a sequence are cut."""
    return pack(token_pieces(docs, path, capacity, ids), capacity)
