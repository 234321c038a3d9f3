"""Consistent sets of tracklets from edges between them."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import ids
from sightline.operators.components import connected_components
from sightline.operators.tables import discard, materialize


def summary(supports: DataFrame, key: str) -> DataFrame:
    """For each association its tracklets, mean score, first and last time, and the id of its earliest support (ties: the smaller id)."""
    ends = F.array_distinct(F.flatten(F.collect_set(F.array("left_id", "right_id"))))
    return supports.groupBy(key).agg(
        F.array_sort(ends).alias("tracklets"),
        F.round(F.avg("score"), 6).alias("score"),
        F.max(F.greatest("left_ts", "right_ts")).alias("ts"),
        F.min("first_ts").alias("first_ts"),
        F.min_by("id", F.struct("first_ts", "id")).alias("id"),
    )


def nodes_of(tracklets: Column) -> Column:
    return F.transform(tracklets, ids.tracklet_node)


def edge_relation(a_left: Column, a_right: Column, b_left: Column, b_right: Column) -> Column:
    """SAME, DISJOINT, CONFLICT (one tracklet in common, and the other end's node occurs in the other edge) or MERGEABLE."""
    n = ids.tracklet_node
    mine = F.when(a_left.isin(b_left, b_right), a_right).otherwise(a_left)
    clash = n(mine).isin(n(b_left), n(b_right))
    return F.when((a_left == b_left) & (a_right == b_right), "SAME").when(~(a_left.isin(b_left, b_right) | a_right.isin(b_left, b_right)), "DISJOINT").when(clash, "CONFLICT").otherwise("MERGEABLE")


def association_relation(a: Column, b: Column) -> Column:
    """How two sets of tracklets stand to each other."""
    left, right = F.array_except(a, b), F.array_except(b, a)
    return (
        F.when(~F.arrays_overlap(a, b), "DISJOINT")
        .when((F.size(left) == 0) & (F.size(right) == 0), "SAME")
        .when(F.size(right) == 0, "LEFT_SUBSUME")
        .when(F.size(left) == 0, "RIGHT_SUBSUME")
        .when(F.arrays_overlap(nodes_of(left), nodes_of(right)), "CONFLICT")
        .otherwise("MERGEABLE")
    )


def superior(a: Column, a_score: Column, b: Column, b_score: Column) -> Column:
    """Whether a is more specific than b, or conflicts with it and is no smaller and scores higher."""
    relation = association_relation(a, b)
    return (relation == "LEFT_SUBSUME") | ((relation == "SAME") & (a_score > b_score)) | ((relation == "CONFLICT") & (F.size(a) >= F.size(b)) & (a_score > b_score))


def sharing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of associations, of two collections, that share a tracklet: a, b (their ids), a_tracklets, b_tracklets, a_score, b_score.

    Both: id, tracklets, score. An equi-join on tracklets, of which each pair is taken once: at the first tracklet that both have.
    """
    side = lambda df, n: df.select(F.col("id").alias(n), F.array_sort("tracklets").alias(f"{n}_tracklets"), F.col("score").alias(f"{n}_score"), F.explode("tracklets").alias("__t"))
    both = side(a, "a").join(side(b, "b"), "__t")
    return both.where(F.col("__t") == F.array_min(F.array_intersect("a_tracklets", "b_tracklets"))).drop("__t")


#: Sets of at most so many tracklets go along with their rows; of larger ones only what they share is counted.
INLINE = 64


def _members(df: DataFrame, n: str) -> DataFrame:
    """A row for each tracklet of each set, without the set."""
    return df.select(F.col("id").alias(n), F.size("tracklets").alias(f"{n}_size"), F.col("score").alias(f"{n}_score"), F.explode("tracklets").alias("__t"))


def _with_nodes(tracklets: str) -> Column:
    return F.transform(tracklets, lambda t: F.named_struct(F.lit("node"), ids.tracklet_node(t), F.lit("t"), t))


def _nodes_meet(a: Column, b: Column) -> Column:
    nodes = lambda some: F.transform(some, lambda t: t["node"])
    return F.arrays_overlap(nodes(F.array_except(a, b)), nodes(F.array_except(b, a)))


def _told(clash: Column) -> Column:
    """The relation of two sets that share `common` tracklets."""
    same, left, right = F.col("a_size") == F.col("b_size"), F.col("common") == F.col("b_size"), F.col("common") == F.col("a_size")
    return F.when(left & right & same, "SAME").when(left, "LEFT_SUBSUME").when(right, "RIGHT_SUBSUME").when(clash, "CONFLICT").otherwise("MERGEABLE")


def related(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of associations, of two collections, that share a tracklet, and how they stand to each other: a, b, relation, a_size, b_size, a_score, b_score.

    Both: id, tracklets (each once), score. Small sets are compared whole where they meet, in a join on tracklets. Of a pair with a large set the shared
    tracklets are counted, and the sets are only fetched if neither holds the other.
    """
    is_small = F.size("tracklets") <= INLINE
    pair = ["a", "b", "relation", "a_size", "b_size", "a_score", "b_score"]
    side = lambda df, n: df.where(is_small).select(F.col("id").alias(n), F.size("tracklets").alias(f"{n}_size"), F.col("score").alias(f"{n}_score"), _with_nodes("tracklets").alias(f"{n}_set"), F.explode("tracklets").alias("__t"))
    met = side(a, "a").join(side(b, "b"), "__t").withColumn("both", F.array_intersect("a_set", "b_set"))
    met = met.where(F.col("__t") == F.array_min(F.transform("both", lambda t: t["t"]))).withColumn("common", F.size("both"))
    near = met.withColumn("relation", _told(_nodes_meet(F.col("a_set"), F.col("b_set")))).select(*pair)

    large_a, large_b = a.where(~is_small), b.where(~is_small)
    crossed = _members(a, "a").join(_members(large_b, "b"), "__t").unionByName(_members(large_a, "a").join(_members(b.where(is_small), "b"), "__t"))
    counted = crossed.groupBy("a", "b", "a_size", "b_size", "a_score", "b_score").agg(F.count("*").alias("common"))
    held = F.col("common") == F.least("a_size", "b_size")
    nested = counted.where(held).withColumn("relation", _told(F.lit(False))).select(*pair)
    whole = lambda df, n: df.select(F.col("id").alias(n), _with_nodes("tracklets").alias(f"{n}_set"))
    apart = counted.where(~held).join(whole(a, "a"), "a").join(whole(b, "b"), "b")
    return near.unionByName(nested).unionByName(apart.withColumn("relation", _told(_nodes_meet(F.col("a_set"), F.col("b_set")))).select(*pair))


def holders(small: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs of an association and one of another collection that holds all of its tracklets: a, b. Both: id, tracklets (each once).

    What holds all tracklets holds the rarest, so each small one is looked up by that tracklet alone in the inverted index of the large ones, and then
    compared whole. A tracklet that many have is hardly ever looked up. For sets beyond INLINE tracklets it is counted what they share with a small one.
    """
    is_small = F.size("tracklets") <= INLINE
    index = large.where(is_small).select(F.col("id").alias("b"), F.col("tracklets").alias("__large"), F.explode("tracklets").alias("__t"))
    often = index.groupBy("__t").agg(F.count("*").alias("__n"))
    wanted = small.where(is_small).select(F.col("id").alias("a"), F.col("tracklets").alias("__small"), F.explode("tracklets").alias("__t"))
    # A tracklet that no large one has rules its association out.
    counted = wanted.join(often, "__t", "left").groupBy("a").agg(F.min_by("__t", F.struct(F.coalesce("__n", F.lit(0)), "__t")).alias("__t"), F.first("__small").alias("__small"))
    near = counted.join(index, "__t").where(F.size(F.array_except("__small", "__large")) == 0).select("a", "b")
    members = lambda df, n: df.select(F.col("id").alias(n), F.size("tracklets").alias(f"{n}_size"), F.explode("tracklets").alias("__t"))
    shared = members(small, "a").join(members(large.where(~is_small), "b"), "__t").groupBy("a", "b", "a_size").agg(F.count("*").alias("common"))
    return near.union(shared.where("common = a_size").select("a", "b"))


def superiors(keys: DataFrame, held: DataFrame) -> DataFrame:
    """For each key the first association of a collection that is superior to it, in order of id: key, superior. Both: id, tracklets, score."""
    better = F.col("a_score") > F.col("b_score")
    above = (F.col("relation") == "LEFT_SUBSUME") | ((F.col("relation") == "SAME") & better) | ((F.col("relation") == "CONFLICT") & (F.col("a_size") >= F.col("b_size")) & better)
    return related(held, keys).where(above).groupBy(F.col("b").alias("key")).agg(F.min("a").alias("superior"))


def without_inferiors(held: DataFrame, keys: DataFrame) -> DataFrame:
    """A collection without the associations that a key is superior to. Both: id, tracklets, score."""
    gone = superiors(held, keys).select(F.col("key").alias("id"))
    return held.join(gone, "id", "left_anti")


def fully_closed(members: DataFrame, closed: DataFrame) -> DataFrame:
    """Associations all of whose tracklets are closed. members: association, tracklet; closed: tracklet."""
    marked = members.join(closed.select("tracklet", F.lit(True).alias("c")).distinct(), "tracklet", "left")
    return marked.groupBy("association").agg(F.count("*").alias("size"), F.count("c").alias("closed")).where("size = closed").select("association", "size")


@dataclass(frozen=True)
class Edge:
    left: str
    right: str
    score: float
    first_ts: int
    ts: int
    id: str


def _node(tracklet: str) -> str:
    return tracklet.rpartition("[")[0]


class Group:
    """An association: supporting edges, and what follows from them."""

    def __init__(self, supports: Iterable[Edge]):
        self.supports = frozenset(supports)
        self.tracklets = frozenset(t for e in self.supports for t in (e.left, e.right))
        self.score = sum(e.score for e in sorted(self.supports, key=lambda e: (e.left, e.right))) / max(1, len(self.supports))
        first = min(self.supports, key=lambda e: (e.first_ts, e.id))
        self.id, self.first_ts, self.ts = first.id, first.first_ts, max(e.ts for e in self.supports)

    def rank(self):
        return -len(self.tracklets), -round(self.score, 9), self.id, tuple(sorted(self.tracklets))


def relation(a: Group, b: Group) -> str:
    left, right = a.tracklets - b.tracklets, b.tracklets - a.tracklets
    if not a.tracklets & b.tracklets:
        return "DISJOINT"
    if not left or not right:
        return "SAME" if not left and not right else "LEFT_SUBSUME" if not right else "RIGHT_SUBSUME"
    return "CONFLICT" if {_node(t) for t in left} & {_node(t) for t in right} else "MERGEABLE"


def put(kept: list[Edge], e: Edge) -> None:
    """Add an edge: of two edges of one pair the higher score stays; lower ones that conflict with it go; the edge itself is added whatever conflicts."""
    for k in list(kept):
        if {k.left, k.right} == {e.left, e.right}:
            if k.score < e.score:
                kept.remove(k)
                kept.append(e)
            return
        if _clash(k, e) and k.score < e.score:
            kept.remove(k)
    kept.append(e)


def _clash(a: Edge, b: Edge) -> bool:
    common = {a.left, a.right} & {b.left, b.right}
    if len(common) != 1:
        return False
    (mine,), (other,) = {a.left, a.right} - common, {b.left, b.right} - common
    return _node(mine) == _node(other) or _node(mine) in {_node(t) for t in common}


def _by_time(edges: Iterable[Edge]) -> list[Edge]:
    return sorted(edges, key=lambda e: (e.ts, e.left, e.right))


def without_conflicts(held: Group, new: Group) -> Group | None:
    """What of `held` does not stand against `new`, then `new`, put together edge by edge."""
    nodes = {_node(x) for x in new.tracklets}
    foreign = {t for t in held.tracklets - new.tracklets if _node(t) in nodes}
    rest = [e for e in held.supports if not {e.left, e.right} & foreign]
    if not rest:
        return None
    kept: list[Edge] = []
    for e in [*_by_time(rest), *_by_time(new.supports)]:
        put(kept, e)
    return Group(kept)


class Closure:
    """Associations none of which holds another one, found by their tracklets: adding one looks at those alone that share a tracklet with it.

    They have an order, in which they came: that of `now`, which says at what event they come, and of a count.
    """

    def __init__(self):
        self.held: dict[frozenset[str], Group] = {}
        self.at: dict[str, set[frozenset[str]]] = {}
        self.place: dict[frozenset[str], list] = {}
        self.count, self.now = 0, []

    def __iter__(self):
        return iter(list(self.held.values()))

    def holds(self, tracklet: str) -> bool:
        return bool(self.at.get(tracklet))

    def touching(self, tracklets: Iterable[str]) -> list[Group]:
        """Those that share a tracklet, in the order in which they came."""
        return [self.held[k] for k in sorted({k for t in tracklets for k in self.at.get(t, ())}, key=self.place.__getitem__)]

    def put(self, g: Group) -> None:
        self.held[g.tracklets], self.place[g.tracklets], self.count = g, [*self.now, self.count], self.count + 1
        for t in g.tracklets:
            self.at.setdefault(t, set()).add(g.tracklets)

    def drop(self, g: Group) -> None:
        del self.held[g.tracklets]
        for t in g.tracklets:
            self.at[t].remove(g.tracklets)

    def add(self, new: Group, expand: bool = True) -> bool:
        """Add an association; whether anything came in. What it holds goes, what holds it keeps it out, a better one of the same tracklets takes
        the place (and the first time, if earlier, of the other); merges with others come in its stead."""
        same = self.held.get(new.tracklets)
        if same is not None:
            if same.score >= new.score:
                return False
            new.first_ts = min(new.first_ts, same.first_ts)
            self.drop(same)
            self.put(new)
            return True
        near = self.touching(new.tracklets)
        if any(g.tracklets > new.tracklets for g in near):
            return False
        merges, conflicts = [], []
        for g in near:
            if g.tracklets < new.tracklets:
                self.drop(g)
            elif relation(g, new) == "MERGEABLE":
                merges.append(g)
            else:
                conflicts.append(g)
        added = False
        for merged in [Group(g.supports | new.supports) for g in merges]:
            added = self.add(merged) or added
        if expand:
            for freed in [f for g in conflicts if (f := without_conflicts(g, new))]:
                added = self.add(freed, False) or added
        if not added:
            self.put(new)
        return True

    def resolve(self, key: Group) -> None:
        """Cut a group's tracklets from all associations; what is left of one is added anew, part by part."""
        touched = self.touching(key.tracklets)
        for g in touched:
            self.drop(g)
        for g in touched:
            for part in cut(g, key.tracklets):
                self.add(part)


def cut(group: Group, key: frozenset[str]) -> list[Group]:
    """What is left of an association without a set of tracklets: its connected parts."""
    rest = [e for e in _by_time(group.supports) if not {e.left, e.right} & key]
    parts: list[set[Edge]] = []
    for e in rest:
        touching = [p for p in parts if any({e.left, e.right} & {x.left, x.right} for x in p)]
        parts = [p for p in parts if p not in touching] + [{e}.union(*touching)]
    return [Group(p) for p in parts]


def best(held: Iterable[Group]) -> list[Group]:
    """Greedily the largest, then the best scored; what the others share with it is cut from them."""
    rest, chosen = sorted(held, key=Group.rank), []
    while rest:
        head, *rest = rest
        chosen.append(head)
        parts: list[Group] = []
        seen: set[frozenset[str]] = set()
        for g in rest:
            for p in cut(g, head.tracklets) if g.tracklets & head.tracklets else [g]:
                if p.tracklets not in seen:
                    seen.add(p.tracklets)
                    parts.append(p)
        rest = sorted(parts, key=Group.rank)
    return chosen


def outranks(a: Group, b: Group) -> bool:
    """Whether a is superior to b: it holds b and more, or the same with a higher score, or conflicts with it, is no smaller and scores higher."""
    how = relation(a, b)
    return how == "LEFT_SUBSUME" or (how == "SAME" and a.score > b.score) or (how == "CONFLICT" and len(a.tracklets) >= len(b.tracklets) and a.score > b.score)


def closure(edges: Iterable[Edge]) -> Closure:
    held = Closure()
    for e in _by_time(edges):
        held.add(Group([e]))
    return held


class Selection:
    """Associations on their way to being final, and closed tracklets that wait with them.

    `restless`: settling once more, with nothing new, could still find something.
    """

    def __init__(self):
        self.held, self.gone, self.settled, self.restless = Closure(), set(), set(), False

    def link(self, e: Edge) -> None:
        self.held.add(Group([e]))
        self.restless = True

    def settle(self, forced: bool = False) -> tuple[list[Group], list[str]]:
        """The best of those associations all of whose tracklets have closed, unless a superior one is held, and closed tracklets that nothing holds.
        Forced: whatever is held."""
        final, now = [], self.held.now
        for g in best([g for g in self.held if g.tracklets <= self.gone]):
            if not forced and any(outranks(h, g) for h in self.held.touching(g.tracklets)):
                continue
            self.held.now = [*now, [*g.rank()[:3], sorted(g.tracklets)]]
            self.held.resolve(g)
            final.append(g)
            self.settled |= g.tracklets
            self.gone -= g.tracklets
        self.held.now, self.restless = now, bool(final)
        lone = sorted(x for x in self.gone if forced or not self.held.holds(x))
        self.gone -= set(lone)
        return final, [x for x in lone if x not in self.settled]


def graduates(edges: Iterable[Edge], closed: Iterable[tuple[int, str]]) -> tuple[list[Group], list[str]]:
    """Associations that become final as tracklets close, and closed tracklets that remain alone.

    Edges and closings (ts, tracklet) come in order of time, edges first. At a closing, the best of those associations all of whose tracklets
    have closed are final, unless the closure still holds a superior one; a final one's tracklets are cut from the others. A closed tracklet that no
    association holds any more, and no final one, is alone. Associations that wait for an open tracklet at the end are neither.
    """
    at, final, alone = Selection(), [], []
    events = [(e.ts, 0, e.left, e.right, e) for e in edges] + [(ts, 1, t, "", None) for ts, t in closed]
    for i, (_, kind, t, _, e) in enumerate(sorted(events, key=lambda x: x[:4])):
        at.held.now = [i]
        if kind == 0:
            at.link(e)
            continue
        at.gone.add(t)
        found, lone = at.settle()
        final += found
        alone += lone
    return final, alone


def _groups(found: Iterable[Group]):
    import pandas as pd

    columns = ["id", "tracklets", "size", "score", "first_ts", "ts"]
    return pd.DataFrame([(g.id, "-".join(sorted(g.tracklets)), len(g.tracklets), round(g.score, 6), g.first_ts, g.ts) for g in found], columns=columns)


def _edges(group) -> list[Edge]:
    return [Edge(r.left_id, r.right_id, r.score, r.first_ts, max(r.left_ts, r.right_ts), r.id) for r in group.itertuples()]


def _dealt(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the connected component that they belong to, and the component of each tracklet. Components never touch each other's tracklets."""
    columns = ["left_id", "right_id", "score", "first_ts", "left_ts", "right_ts", "id"]
    edges = materialize(edges.select(*columns))
    part = materialize(connected_components(edges, "left_id", "right_id", dense=True)).withColumnRenamed("id", "__id")
    return edges.join(part, F.col("left_id") == F.col("__id")).drop("__id"), part


SHAPE = "id string, tracklets string, size int, score double, first_ts long, ts long"


def closures(edges: DataFrame) -> DataFrame:
    """All consistent associations that edges, taken in order of time, grow into. There can be as many as a component has ways to choose a
    tracklet for each node, as there is no other rule than consistency; a component is walked by one task."""
    return _dealt(edges)[0].groupBy("component").applyInPandas(lambda group: _groups(closure(_edges(group))), SHAPE)


def best_associations(edges: DataFrame) -> DataFrame:
    """Associations that share no tracklet, the best first."""
    return _dealt(edges)[0].groupBy("component").applyInPandas(lambda group: _groups(best(closure(_edges(group)))), SHAPE)


def final_assignments(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """tracklet, association: of final associations for their members, of its own for every closed tracklet that remains alone (see graduates).

    closed: tracklet, ts. Tracklets of associations that wait for open ones have none yet.
    """
    import pandas as pd

    dealt, part = _dealt(edges)
    ends = materialize(closed.groupBy("tracklet").agg(F.min("ts").alias("closed_ts")))
    placed = ends.join(part, F.col("tracklet") == F.col("__id"), "left")

    def walk(group, closings):
        final, alone = graduates(_edges(group), zip(closings.closed_ts, closings.tracklet))
        rows = [(t, g.id) for g in final for t in sorted(g.tracklets)] + [(t, t) for t in alone]
        return pd.DataFrame(rows, columns=["tracklet", "association"])

    told = dealt.groupBy("component").cogroup(placed.where("component is not null").select(F.col("component").alias("__c"), "tracklet", "closed_ts").groupBy("__c")).applyInPandas(walk, "tracklet string, association string")
    return told.union(placed.where("component is null").select("tracklet", F.col("tracklet").alias("association")))


def greedy_edges(edges: DataFrame) -> DataFrame:
    """Edges that share no tracklet: the best score first (then the smaller ids), and none that touches one before it.

    In rounds: edges that are the best at both of their ends are chosen, which are just those that the order would choose, and what they touch goes.
    """
    columns = ["left_id", "right_id", "score"]
    rest, chosen = materialize(edges.select(*columns)), []
    while not rest.isEmpty():
        rank = F.struct((-F.col("score")).alias("s"), "left_id", "right_id")
        ends = rest.select(F.explode(F.array("left_id", "right_id")).alias("t"), rank.alias("r")).groupBy("t").agg(F.min("r").alias("r"))
        picked = materialize(ends.groupBy("r").agg(F.count("*").alias("n")).where("n = 2").select(F.col("r.left_id").alias("left_id"), F.col("r.right_id").alias("right_id"), (-F.col("r.s")).alias("score")))
        chosen.append(picked)
        taken = picked.select(F.explode(F.array("left_id", "right_id")).alias("t"))
        last = rest
        rest = materialize(rest.join(taken.withColumnRenamed("t", "left_id"), "left_id", "left_anti").join(taken.withColumnRenamed("t", "right_id"), "right_id", "left_anti").select(*columns))
        discard(last)
    return functools.reduce(DataFrame.union, chosen) if chosen else rest


def without_tracklet(supports: DataFrame, key: str, tracklet: str) -> DataFrame:
    """Associations once a tracklet is taken out of them."""
    return summary(supports.where((F.col("left_id") != tracklet) & (F.col("right_id") != tracklet)), key)
