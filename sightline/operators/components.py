"""Connected components of an undirected graph of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.tables import discard, observed

#: Links that a task ties together at once before any are shuffled.
AT_ONCE = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbered ends the least one that the links a-b reach from it."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while len(a) and (root[root] != root).any():
            root = root[root]
    return root


def tied(links: DataFrame) -> DataFrame:
    """Links u, v that hang the same together as the given ones do: of what lies in one task, many at a time, every end with one that it reaches; loops stay."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table["u"].chunks, *table["v"].chunks]).combine_chunks().dictionary_encode()
        at, names = ends.indices.to_numpy().astype(np.int64), ends.dictionary
        u, v = at[: table.num_rows], at[table.num_rows :]
        root = roots(u, v, len(names))
        far = np.unique(np.concatenate([np.flatnonzero(root != np.arange(len(root))), u[u == v]]))
        return pa.RecordBatch.from_arrays([names.take(pa.array(far)), names.take(pa.array(root[far]))], names=["u", "v"])

    return links.mapInArrow(tie, links.schema)


def connected_components(links: DataFrame, left: str = "a", right: str = "b", dense: bool = False) -> DataFrame:
    """For each end of a link, the smallest id that links reach from it: columns id, component.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest one, then its smaller neighbours too.
    Both keep the components and shorten paths, so rounds grow with the logarithm of the longest path. A step groups with a partial minimum
    and joins it back, so no neighbour list is ever gathered. `dense`: before the first step each task ties its own links together, so that
    of many links between few ends little more than the ends is shuffled. Loops and repeated links do no harm; links with a null end are ignored. `links` is evaluated once.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    pairs = (tied(pairs) if dense else pairs).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, seen = observed(pairs, F.count_if(F.col("u") != F.col("v")).alias("n"))
    loops, edges = links.where("u = v").select("u"), links.where("u <> v")
    if not seen["n"]:
        return loops.select(F.col("u").alias("id"), F.col("u").alias("component"))
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last = edges
        edges, now = observed(star.where("u <> v").distinct(), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        discard(last)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
    alone = loops.join(found, F.col("u") == F.col("id"), "left_anti").select(F.col("u").alias("id"), F.col("u").alias("component"))
    return found.union(alone)
