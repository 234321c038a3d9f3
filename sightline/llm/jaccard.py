"""N-gram Jaccard join with a count-vector R-tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Words, discard, fields_of, materialize, mix, ngram_hash, sliced, small, spare, utf8
from sightline.operators.components import connected_components

#: Coordinates of a count vector, and entries of a tree node.
GROUPS, FANOUT = 64, 16
#: Shingles of the documents that one task compares, about, at most.
TASK = 250_000
_SALT = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Measure:
    """Sets of `width`-word shingles; a link needs den * intersection >= num * union."""

    width: int = 3
    num: int = 9
    den: int = 10
    ratio: float = 1.3  # of the sizes in a class
    slack: int = 4  # spare groups: one for `slack` that may differ
    least: int = 3  # shingles of a group that makes a signature by itself
    bands: int = 0  # if above 0, signatures are bands of minima instead, `rows` in each
    rows: int = 5

    def need(self, sizes):
        """The least intersection for sizes that sum up to this."""
        return -(-self.num * sizes // (self.num + self.den))

    def classes(self) -> np.ndarray:
        """Where size classes begin."""
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * self.ratio)))
        return np.array(bounds, np.int64)

    def differ(self, top: np.ndarray) -> np.ndarray:
        """Shingles at most that are in just one of two linked sets of no more than `top` each."""
        return 2 * top * (self.den - self.num) // (self.den + self.num)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; with fewer words than `width`, all words as one."""
    data, offsets = utf8(column)
    words = Words(data, offsets, lower=True)
    out = []
    for a, b in zip(words.at[:-1], words.at[1:]):
        own = words.hash[a:b]
        out.append(np.unique(ngram_hash(own, width)) if b - a >= width else ngram_hash(own, b - a) + np.uint64(b - a) if b > a else own[:0])
    return out


def signatures(sets: list[np.ndarray], m: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Rows and signatures such that two linked, unequal sets share a signature.

    Linked sets of a class differ in k shingles at most. Hashed into k + 1 + s groups, s + 1 groups are equal in both. If one set has s thin
    groups at most (fewer than `least` shingles), one of the equal groups is not thin, and its content is a shared signature. A set with more
    thin groups also gives every group that is not empty; with more than s empty groups, also one signature for its class.
    A set is taken in its own class, and in those above that sets linked with it may belong to.
    """
    size = np.array([len(s) for s in sets], np.int64)
    bounds = m.classes()
    own = np.searchsorted(bounds, size, "right") - 1
    high = np.searchsorted(bounds, m.den * size // m.num, "right") - 1
    rows, found = [], []
    for up in range(int((high - own).max(initial=0)) + 1):
        mine = np.flatnonzero((size > 0) & (own + up <= high))
        k = m.differ(bounds[own[mine] + up + 1] - 1)
        mine, k = mine[k > 0], k[k > 0]
        if not len(mine):
            continue
        label = (own[mine] + up).astype(np.uint64)
        spare = k // m.slack + 3
        groups = k + 1 + spare
        start = np.concatenate([[0], np.cumsum(groups)])
        h, n = np.concatenate([sets[i] for i in mine]), size[mine]
        slot = np.repeat(start[:-1], n) + (mix(h ^ _SALT) % np.repeat(groups, n).astype(np.uint64)).astype(np.int64)
        held = np.bincount(slot, minlength=start[-1])
        content = np.zeros(start[-1], np.uint64)
        np.add.at(content, slot, mix(h + _SALT))
        group = np.arange(start[-1]) - np.repeat(start[:-1], groups)
        name = mix(content + mix(np.repeat(label, groups) * _SALT + group.astype(np.uint64)))
        thin, empty = (np.add.reduceat(x.astype(np.int64), start[:-1]) for x in (held < m.least, held == 0))
        row = np.repeat(mine, groups)
        more = np.repeat(thin > spare, groups) & (held > 0)
        for chosen, level in ((held >= m.least, 0), (more, 1)):
            rows.append(row[chosen])
            found.append(mix(name[chosen] + np.uint64(level)))
        rest = empty > spare
        rows.append(mine[rest])
        found.append(mix(label[rest] + _SALT))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row, sig = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(row, kind="stable")
    return row[order], sig[order]


def bands_of_minima(sets: list[np.ndarray], m: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Rows and signatures: hashes of `rows` MinHash values for each band. Two sets of similarity j share none with chance (1 - j**rows)**bands,
    5e-9 for 48 bands of 5 at 0.8. Far fewer than the exact signatures where the threshold is low, and sets of any size get as many."""
    odd = mix(np.arange(1, m.bands * m.rows + 1, dtype=np.uint64) * _SALT) | np.uint64(1)
    mine = np.flatnonzero([len(s) > 0 for s in sets])
    found = np.empty((len(mine), m.bands), np.uint64)
    for at, i in enumerate(mine):
        step = max(1, (1 << 17) // len(sets[i]))
        low = np.concatenate([(odd[k : k + step, None] * sets[i][None, :]).min(axis=1) for k in range(0, len(odd), step)]).reshape(m.bands, m.rows)
        name = np.arange(m.bands, dtype=np.uint64)
        for j in range(m.rows):
            name = mix(name * _SALT + low[:, j])
        found[at] = name
    return np.repeat(mine, m.bands), found.ravel()


class CountTree:
    """An R-tree over count vectors, loaded in bulk: points sorted by size and tiled by their fullest group, FANOUT to a node.

    A node keeps the upper corner of its box and its sizes' range. The overlap of a set with any set below is at most the summed minima of its
    counts and that corner, so a node is left out if these stay under what a set of its least size would need.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, m: Measure):
        self.m, self.counts, self.sizes = m, counts, sizes
        self.order = np.lexsort((counts.argmax(axis=1), sizes // 4, sizes))
        self.levels = []
        high, low = counts[self.order], sizes[self.order]
        while len(low) > FANOUT:
            cut = np.arange(0, len(low), FANOUT)
            high, low = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut)
            self.levels.append((high, low))

    def near(self, i: int) -> np.ndarray:
        """Points whose bound on the overlap with point i is what a link needs."""
        v, n = self.counts[i], int(self.sizes[i])
        at = np.arange(len(self.levels[-1][1])) if self.levels else None
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            at = at[(low[at] * self.m.num <= n * self.m.den) & (np.minimum(high[at], v).sum(axis=1) >= self.m.need(n + low[at]))]
            width = len(self.levels[depth - 1][1]) if depth else len(self.order)
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < width]
        points = self.order if at is None else self.order[at]
        return points[np.minimum(self.counts[points], v).sum(axis=1) >= self.m.need(n + self.sizes[points])]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def spanning_links(sets: list[np.ndarray], side: np.ndarray, m: Measure) -> list[tuple[int, int]]:
    """Links that connect what all links connect. Only pairs that are not connected yet are verified. If both sides occur, pairs are of two sides."""
    two = side.min() != side.max()
    sizes = np.array([len(s) for s in sets], np.int64)
    counts = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=GROUPS) for s in sets])
    tree = CountTree(counts, sizes, m)
    group = np.arange(len(sets))
    members = {i: [i] for i in range(len(sets))}
    links = []
    for i in np.argsort(sizes, kind="stable"):
        near = tree.near(i)
        near = near[(group[near] != group[i]) & ((sizes[near] > sizes[i]) | ((sizes[near] == sizes[i]) & (near > i)))]
        if two:
            near = near[side[near] != side[i]]
        for j in near:
            if group[j] == group[i]:
                continue
            both = shared(sets[i], sets[j])
            if m.den * both >= m.num * (sizes[i] + sizes[j] - both):
                links.append((int(i), int(j)))
                keep, gone = sorted((group[i], group[j]), key=lambda g: -len(members[g]))
                group[members[gone]] = keep
                members[keep] += members.pop(gone)
    return links


def profile(docs: DataFrame, m: Measure) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (128 bits that stand for the set) and sigs of every whole text."""

    def profiled(batches):
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text"), m.width)
            row, sig = bands_of_minima(sets, m) if m.bands else signatures(sets, m)
            offsets = np.searchsorted(row, np.arange(len(sets) + 1)).astype(np.int32)
            total = lambda salt: pa.array([int(mix(s + salt).sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "f1": total(_SALT), "f2": total(_SALT * np.uint64(3)), "sigs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.astype(np.int64)))}
            )

    return docs.select("doc_id", "text").mapInArrow(profiled, f"{fields_of(docs.select('doc_id').schema)}, n bigint, f1 bigint, f2 bigint, sigs array<bigint>")


def tasks(members: DataFrame, m: Measure) -> DataFrame:
    """Deal candidate groups to tasks of about TASK shingles: doc_id, task, grp, side.

    members: doc_id, grp, n. Small groups are packed together. A large one is cut by size into bins that linked sets share or have next to each
    other, and bins into parts; each pair of parts that can hold a link is a task, so every pair of documents still meets.
    """
    totals = materialize(members.groupBy("grp").agg(F.sum("n").alias("total")))
    light = totals.where(F.col("total") <= TASK)
    packs = int((light.agg(F.sum("total")).first()[0] or 0) // TASK) * 2 + 1
    packed = members.join(light, "grp").select("doc_id", F.concat(F.lit("p"), F.pmod(F.xxhash64("grp"), F.lit(packs))).alias("task"), "grp", F.lit(0).alias("side"))
    heavy = members.join(totals.where(F.col("total") > TASK), "grp").drop("total")
    heavy = heavy.withColumn("bin", F.floor(F.log(F.col("n").cast("double")) / float(np.log(m.den / m.num)) + 1e-9))
    bins = heavy.groupBy("grp", "bin").agg(F.ceil(F.sum("n") / (TASK // 2)).alias("parts"))
    blocks = bins.select("grp", "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    other = blocks.select(F.col("grp").alias("g"), F.col("bin").alias("bin2"), F.col("part").alias("part2"))
    meet = (F.col("grp") == F.col("g")) & (((F.col("bin") == F.col("bin2")) & (F.col("part") <= F.col("part2"))) | F.col("bin2").between(F.col("bin") + 1, F.col("bin") + 2))
    pairs = blocks.join(other, meet).withColumn("task", F.concat_ws("/", F.lit("h"), "grp", "bin", "part", "bin2", "part2"))
    same = (F.col("bin") == F.col("bin2")) & (F.col("part") == F.col("part2"))
    first = pairs.select("grp", "bin", "part", "task", F.lit(0).alias("side"))
    second = pairs.where(~same).select("grp", F.col("bin2").alias("bin"), F.col("part2").alias("part"), "task", F.lit(1).alias("side"))
    placed = heavy.join(bins, ["grp", "bin"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    dealt = placed.join(first.union(second), ["grp", "bin", "part"]).select("doc_id", "task", "grp", "side")
    return packed.union(dealt)


def one_row_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id and text, equal rows of the ids in `repeated` once. Only those are shuffled, merged where they lie first."""
    rows, again = docs.select("doc_id", "text"), small(repeated.select(F.col("doc_id").alias("__again")))
    same = F.col("doc_id") == F.col("__again")
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates())


def verified_links(docs: DataFrame, dealt: DataFrame, m: Measure) -> DataFrame:
    """Read the texts of candidates again, and compare them task by task with a count-vector R-tree. Links a, b. docs has each id and text once."""

    def encode(batches):
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text"), m.width)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "task": batch.column("task"), "grp": batch.column("grp"), "side": batch.column("side"), "s": pa.array([s.tobytes() for s in sets], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("doc_id", "ascending")])
        grp, side = (table.column(c).to_numpy() for c in ("grp", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
        ids, out = table.column("doc_id").combine_chunks(), []
        for mine in np.split(np.arange(len(grp)), np.flatnonzero(grp[1:] != grp[:-1]) + 1):
            if len(mine) > 1:
                out += [(mine[i], mine[j]) for i, j in spanning_links([sets[i] for i in mine], side[mine], m)]
        at = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": ids.take(pa.array(at[:, 0])), "b": ids.take(pa.array(at[:, 1]))})

    chosen = docs.select("doc_id", "text").join(small(dealt.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "task", "grp", "side")
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = chosen.mapInArrow(encode, f"{fields_of(dealt.schema)}, s binary")
    return encoded.groupBy("task").applyInArrow(compare, f"a {kind}, b {kind}")


def components(docs: DataFrame, m: Measure = Measure()) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their shingle sets: doc_id, n_shingles, component_id.

    docs: doc_id, text; other columns are not read. Words part at ASCII white space and A-Z count as a-z. component_id is the smallest doc_id
    that links reach. Null, empty and blank texts have an empty set and no link. Equal sets are linked, and compared once. Each row of the input
    gives one of the result. Rows of one id are one document: what any of them is linked with, all are, whatever their texts; n_shingles is each
    row's own. A null id is linked with nothing and has a null component. Ids are of any type that has an order. Sets are held as 64-bit hashes
    of shingles.

    1. Each distinct set gives signatures; linked sets share one (see signatures; with bands, but for the chance given there). No row is dropped for being in a crowd: documents of a
       signature are tied to the smallest of them (found with a partial minimum, so that a crowd is never in one task), and ties make
       candidate groups, of which every link is an inside one.
    2. Candidate groups are dealt to tasks of bounded size, where a count-vector R-tree finds pairs whose summed minima can reach the overlap
       a link needs; survivors are verified on whole sets. A task returns a spanning forest, not all pairs.
    """
    table = materialize(profile(docs, m))
    sets = materialize(table.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")))
    signed = table.where("doc_id is not null").select("doc_id", F.explode("sigs").alias("sig"))
    crowds = materialize(signed.groupBy("sig").agg(F.min("doc_id").alias("star"), F.max("doc_id").alias("last")).where("star < last").drop("last"))
    ties = signed.join(crowds, "sig").where("star < doc_id").select("star", "doc_id").distinct()
    ties = ties.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    groups = materialize(connected_components(ties, "star", "doc_id"))
    discard(crowds)
    sizes = table.groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    members = materialize(groups.join(sizes, F.col("id") == F.col("doc_id")).select("doc_id", F.xxhash64("component").alias("grp"), "n", "copies"))
    discard(groups)
    repeated = members.where("copies > 1").select("doc_id").distinct()
    dealt = materialize(tasks(members.drop("copies"), m))
    links = materialize(verified_links(docs if repeated.isEmpty() else one_row_each(docs, repeated), dealt, m))
    discard(members)
    discard(dealt)
    tagged = materialize(table.select("doc_id", "n", "f1", "f2").join(sets, ["f1", "f2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")))
    discard(sets)
    discard(table)
    # Sets of one id are linked, and a row without words has the component of its id's other rows.
    least = materialize(tagged.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")))
    several = tagged.join(least.where("least < most").drop("most"), "doc_id").where("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    found = materialize(connected_components(links.union(several)))
    discard(links)
    bare = tagged.where("rep is null").select(F.col("doc_id").alias("__bare")).distinct()
    mixed = least.join(bare, F.col("doc_id") == F.col("__bare"), "left_semi").select(F.col("doc_id").alias("__d"), F.col("least").alias("__rep"))
    whole = tagged.join(mixed, F.col("rep").isNull() & (F.col("doc_id") == F.col("__d")), "left").select("doc_id", "n", F.coalesce("rep", "__rep").alias("rep"))
    return whole.join(found, F.col("rep") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, m: Measure) -> DataFrame:
    """One document of each component stays, the one with the smallest id; documents without words, or without an id, are components of their own.

    All columns, as they are. Rows of one id are one document, so all of them stay or go.
    """
    id = spare(docs.columns, "__id")
    others = materialize(components(docs, m).where("doc_id <> component_id").select(F.col("doc_id").alias(id)).distinct())
    return docs.join(small(others), F.col("doc_id") == F.col(id), "left_anti")
