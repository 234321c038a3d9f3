"""Operators on tracks against rows made by hand, models in plain Python, and DuckDB."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry, ids, vectors
from sightline.operators import associations as A
from sightline.operators import feature, global_tracks, indexes, rangejoin, stores, tracks, windows, zones
from sightline.operators.components import connected_components
from sightline.plans import catalog

DATA = Path("/root/testdata/sf0.001")
LOG = "node string, track_id string, ts bigint, seq bigint, x double, y double, distance double, zone string, first_ts bigint, is_deleted boolean"


def log(spark, *rows):
    return spark.createDataFrame([("cam:01", t, ts, i, float(x), float(y), float(d), z, 0, gone) for i, (t, ts, x, y, d, z, gone) in enumerate(rows)], LOG)


def test_index_ignores_deletes_first_and_keeps_open_ends(spark):
    df = log(spark, ("1", 1, 0, 0, 1, None, True), ("2", 1, 0, 0, 1, None, False), ("2", 2, 0, 0, 1, "A", False), ("2", 3, 0, 0, 1, "B", False), ("3", 1, 0, 0, 1, "C", False), ("2", 4, 0, 0, 1, None, True))
    found = {r.track_id: (r.enter_zone, r.exit_zone, r.last_ts, r.last_offset, r["count"]) for r in indexes.track_index(df).collect()}
    assert found == {"2": ("A", "B", 4, 5, 4), "3": ("C", "C", -1, -1, 1)}
    assert indexes.oldest_open(indexes.track_index(df)).first()[0] == 4


def test_gate_passes_deletes(spark):
    area = spark.createDataFrame([("a", "cam:01", 5.0)], "area string, node string, threshold double")
    df = log(spark, ("1", 1, 0, 0, 5, None, False), ("2", 1, 0, 0, 6, None, False), ("3", 1, 0, 0, 9, None, True))
    assert sorted(r.track_id for r in tracks.distance_gate(df, area).collect()) == ["1", "3"]


def test_hopping_windows_are_half_open(spark):
    df = spark.createDataFrame([(0,), (999,), (1000,), (1500,)], "ts bigint")
    found = sorted((r.ts, r.w_begin) for r in windows.hopping(df, 1000, 500).collect())
    assert found == [(0, -500), (0, 0), (999, 0), (999, 500), (1000, 500), (1000, 1000), (1500, 1000), (1500, 1500)]
    first = sorted((r.ts, r.w_begin) for r in windows.hopping(df.where("ts > 0"), 1000, 500, anchor="first_event").collect())
    assert first == [(999, 999), (1000, 999), (1500, 999), (1500, 1499)]


def test_windows_start_anew_after_a_gap(spark):
    df = spark.createDataFrame([("k", 0), ("k", 600), ("k", 5003)], "key string, ts bigint")
    assert sorted((r.ts, r.w_begin) for r in windows.reanchored(df, 1000, 500, ["key"]).collect()) == [(0, 0), (600, 0), (600, 500), (5003, 5003)]


def test_ids(spark):
    row = spark.createDataFrame([("cam[0]", "12")], "n string, t string").select(ids.tracklet_id(F.col("n"), F.col("t")).alias("i"))
    assert row.select("i", ids.tracklet_node(F.col("i")), ids.tracklet_track(F.col("i"))).first() == ("cam[0][12]", "cam[0]", "12")
    text = spark.sql("select array('a[10]', 'a[9]', 'b[1]') as s").select(ids.association_text(F.col("s"), F.lit("a[10]"))).first()[0]
    assert text == "a[9]-a[10]*-b[1]"


def test_geometry(spark):
    ring = "array(struct(0d as x, 0d as y), struct(4d as x, 0d as y), struct(0d as x, 4d as y), struct(0d as x, 0d as y))"
    points = spark.sql(f"select {ring} as ring, struct(px as x, py as y) as p from values (1d, 1d), (3d, 3d), (2d, 2d), (-1d, 0d) as t(px, py)")
    assert [r[0] for r in points.select(geometry.in_ring(F.col("p"), F.col("ring"))).collect()] == [True, False, True, False]
    line = spark.sql(f"select {ring} as ring, struct(-1d as x, 1d as y) as a, struct(5d as x, 1d as y) as b, struct(9d as x, 9d as y) as c")
    assert line.select(geometry.segment_meets_ring(F.col("a"), F.col("b"), F.col("ring")), geometry.segment_meets_ring(F.col("b"), F.col("c"), F.col("ring"))).first() == (True, False)
    lon, lat = geometry.to_wgs84(F.lit(200000.0), F.lit(600000.0))
    assert spark.range(1).select(F.round(lon, 8), F.round(lat, 8)).first() == (127.0, 38.0)
    path = spark.sql("select array(struct(0d as x, 0d as y), struct(1d as x, 0d as y), struct(2d as x, 0d as y)) as l, array(struct(1d as x, 1d as y), struct(2d as x, 1d as y)) as s")
    assert path.select(geometry.path_alignment(F.col("l"), F.col("s")).alias("m")).select("m.d", "m.o").first() == (1.0, 1)
    assert spark.sql("select array(3f, 4f) as v").select(vectors.norm(F.col("v")), vectors.cosine(F.col("v"), F.col("v"))).first() == (5.0, 1.0)


def test_range_join_bounds_are_inclusive(spark):
    p = spark.createDataFrame([("a", 10), ("a", 21), ("b", 10)], "k string, p bigint")
    i = spark.createDataFrame([("a", 10, 20), ("a", 0, 10)], "k string, low bigint, high bigint")
    assert sorted((r.p, r.low) for r in rangejoin.interval_join(p, i, "p", "low", "high", ["k"], 7).collect()) == [(10, 0), (10, 10)]


def test_components_match_a_plain_walk(spark):
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(60)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def edge(a, b, score, ts):
    return A.Edge(a, b, score, ts, ts, a)


def test_closure_merges_and_keeps_one_tracklet_a_node():
    held = list(A.closure([edge("a[1]", "b[1]", 0.9, 1), edge("b[1]", "c[1]", 0.8, 2), edge("a[2]", "b[1]", 0.5, 3)]))
    assert {frozenset(g.tracklets) for g in held} >= {frozenset({"a[1]", "b[1]", "c[1]"})}
    chosen = A.best(held)
    assert chosen[0].tracklets == {"a[1]", "b[1]", "c[1]"}
    seen = [t for g in chosen for t in g.tracklets]
    assert len(seen) == len(set(seen))
    for g in held:
        nodes = [t.partition("[")[0] for t in g.tracklets]
        assert len(nodes) == len(set(nodes))


def plain_add(held, new, expand=True):
    """The rules of a closure over a plain list, one association after another."""
    merges, conflicts = [], []
    for old in list(held):
        how = A.relation(old, new)
        if how == "SAME":
            if old.score >= new.score:
                return False
            new.first_ts = min(old.first_ts, new.first_ts)
            held.remove(old)
            held.append(new)
            return True
        if how == "LEFT_SUBSUME":
            return False
        if how == "RIGHT_SUBSUME":
            held.remove(old)
        if how == "MERGEABLE":
            merges.append(old)
        if how == "CONFLICT":
            conflicts.append(old)
    results = [plain_add(held, m) for m in [A.Group(m.supports | new.supports) for m in merges]]
    if expand:
        results += [plain_add(held, f, False) for f in [A.without_conflicts(c, new) for c in conflicts] if f]
    if not any(results):
        held.append(new)
    return True


def told(groups):
    return sorted((sorted(g.tracklets), round(g.score, 9), g.id, g.first_ts, g.ts) for g in groups)


def random_edges(rng, nodes, tracks, n):
    out = {}
    for ts in range(n):
        (x, y) = sorted(rng.sample(range(nodes), 2))
        a, b = f"n{x}[{rng.randrange(tracks)}]", f"n{y}[{rng.randrange(tracks)}]"
        out[a, b] = A.Edge(a, b, round(rng.random(), 3), rng.randrange(50), ts, rng.choice((a, b)))
    return list(out.values())


def test_closure_equals_a_plain_list():
    rng = random.Random(11)
    for trial in range(60):
        edges = random_edges(rng, rng.choice([3, 4, 5]), rng.choice([2, 3]), rng.choice([4, 8, 14]))
        plain = []
        for e in sorted(edges, key=lambda e: (e.ts, e.left, e.right)):
            plain_add(plain, A.Group([e]))
        assert told(A.closure(edges)) == told(plain), trial


def test_closure_of_a_dense_component_is_whole():
    """Eight cameras with two tracks each, all linked: every way to choose is an association, and none is lost."""
    rng = random.Random(1)
    edges = [A.Edge(f"n{x}[{i}]", f"n{y}[{j}]", 0.5 + rng.random() / 2, 0, 1, f"n{x}[{i}]") for x in range(6) for y in range(x + 1, 6) for i in range(2) for j in range(2)]
    held = list(A.closure(edges))
    assert {g.tracklets for g in held} == {frozenset(f"n{x}[{b >> x & 1}]" for x in range(6)) for b in range(64)}


def test_an_edge_is_added_whatever_conflicts():
    kept = []
    for e in (edge("a[1]", "b[1]", 0.9, 1), edge("a[1]", "b[2]", 0.2, 2), edge("a[1]", "b[1]", 0.3, 3), edge("a[1]", "b[3]", 0.5, 4)):
        A.put(kept, e)
    assert [(k.left, k.right, k.score) for k in kept] == [("a[1]", "b[1]", 0.9), ("a[1]", "b[3]", 0.5)]


def test_final_associations_wait_for_superiors():
    edges = [edge("a[1]", "b[1]", 0.9, 1), edge("b[1]", "c[1]", 0.8, 2), edge("d[1]", "e[1]", 0.7, 3), edge("d[1]", "e[2]", 0.9, 4)]
    final, alone = A.graduates(edges, [(10, "a[1]"), (11, "b[1]"), (12, "x[1]")])
    assert final == [] and alone == ["x[1]"]
    final, alone = A.graduates(edges, [(10, "a[1]"), (11, "b[1]"), (12, "c[1]")])
    assert [sorted(g.tracklets) for g in final] == [["a[1]", "b[1]", "c[1]"]] and alone == []
    # d1-e1 has closed, but d1-e2 conflicts with it and scores higher: it waits until that one closes, and then e1 is alone.
    closings = [(10, "d[1]"), (11, "e[1]")]
    assert A.graduates(edges, closings) == ([], [])
    final, alone = A.graduates(edges, [*closings, (12, "e[2]")])
    assert [sorted(g.tracklets) for g in final] == [["d[1]", "e[2]"]] and alone == ["e[1]"]


def frame_of(spark, edges):
    rows = [(e.left, e.right, e.score, e.first_ts, e.ts, e.ts, e.id) for e in edges]
    return spark.createDataFrame(rows, "left_id string, right_id string, score double, first_ts long, left_ts long, right_ts long, id string")


def test_association_tables_equal_plain_walks(spark):
    rng = random.Random(5)
    edges = [e for k in range(4) for e in (A.Edge(f"s{k}{e.left}", f"s{k}{e.right}", e.score, e.first_ts, e.ts, f"s{k}{e.id}") for e in random_edges(rng, 4, 2, 9))]
    df = frame_of(spark, edges)
    rows = lambda d: sorted((r.tracklets, r.score, r.id, r.first_ts, r.ts) for r in d.collect())
    plain = lambda groups: sorted(("-".join(sorted(g.tracklets)), round(g.score, 6), g.id, g.first_ts, g.ts) for g in groups)
    assert rows(A.closures(df)) == plain(A.closure(edges))
    assert rows(A.best_associations(df)) == plain(A.best(A.closure(edges)))
    closed = [(20 + i, t) for i, t in enumerate(sorted({x for e in edges for x in (e.left, e.right)})) if i % 5] + [(99, "lone[1]")]
    final, alone = A.graduates(edges, closed)
    expected = sorted([(t, g.id) for g in final for t in g.tracklets] + [(t, t) for t in alone])
    found = A.final_assignments(df, spark.createDataFrame(closed, "ts long, tracklet string"))
    assert sorted(map(tuple, found.collect())) == expected and expected
    assert A.closures(df.where("false")).count() == 0 and A.final_assignments(df.where("false"), spark.createDataFrame(closed[-1:], "ts long, tracklet string")).count() == 1


def test_store_merges_into_the_best(spark):
    from sightline.operators import stores

    e = [edge("a[1]", "b[1]", 0.9, 1), edge("b[1]", "c[1]", 0.8, 2), edge("d[1]", "e[1]", 0.7, 3), edge("a[2]", "b[1]", 0.3, 4), edge("q[1]", "r[1]", 0.5, 1)]
    rows = lambda es, k: stores.as_associations(frame_of(spark, es).withColumn("k", F.lit(k)), "k")
    held = rows([e[0]], 1).union(rows([e[2]], 2)).union(rows([e[4]], 3))
    found = stores.merge_associations(held, rows([e[1]], 1).union(rows([e[3]], 2)))
    assert sorted((r.id, r.tracklets) for r in found.collect()) == [("a[1]", ["a[1]", "b[1]", "c[1]"]), ("d[1]", ["d[1]", "e[1]"]), ("q[1]", ["q[1]", "r[1]"])]
    assert {r.tracklet: r.association for r in stores.associated_tracklets(found).collect()}["c[1]"] == "a[1]"
    assert stores.merge_associations(held.where("false"), held.where("false")).count() == 0 and stores.merge_associations(held, held.where("false")).count() == 3
    rng = random.Random(6)
    for _ in range(40):
        groups = [A.Group([x]) for x in random_edges(rng, 4, 2, 8)]
        store = stores.merge_into([], groups)
        assert len({g.id for g in store}) == len(store) and {t for g in store for t in g.tracklets} <= {t for g in groups for t in g.tracklets}


def test_matches_become_edges(spark):
    from sightline.operators import stores

    shape = "session_id string, candidate_id string, score double, session_ts long, candidate_ts long, session_first long, candidate_first long"
    found = stores.match_edges(spark.createDataFrame([("b[1]", "a[10]", 0.9, 9, 5, 8, 1), ("b[1]", "c[1]", 0.2, 9, 5, 8, 1)], shape), 0.3).collect()
    assert [tuple(r) for r in found] == [("a[10]", "b[1]", 0.9, 5, 9, "a[10]", 1)]


def test_greedy_edges_equal_a_plain_walk(spark):
    edges, taken, expected = random_edges(random.Random(2), 5, 6, 70), set(), []
    for e in sorted(edges, key=lambda e: (-e.score, e.left, e.right)):
        if not {e.left, e.right} & taken:
            taken |= {e.left, e.right}
            expected.append((e.left, e.right, e.score))
    found = A.greedy_edges(frame_of(spark, edges))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert A.greedy_edges(frame_of(spark, edges).where("false")).count() == 0


def test_lines_in_stripes_equal_a_plain_test_of_every_zone(spark):
    rng = random.Random(4)
    boxes = [(f"z{i}", rng.randrange(80), rng.randrange(80), rng.randrange(1, 30), rng.randrange(1, 30)) for i in range(12)]
    ring = lambda x, y, w, h: [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]
    z = spark.createDataFrame([(n, ring(*b)) for n, *b in boxes], "zone string, ring array<struct<x: double, y: double>>")
    points = [("1" if i % 3 else "2", i, rng.randrange(110), rng.randrange(110), 1, None, False) for i in range(150)]
    found = {(r.seq, r.zone): r.relation for r in zones.zone_relations(tracks.lines(log(spark, *points)), z).collect()}
    expected, last = {}, {}
    for seq, (t, _, x, y, *_) in enumerate(points):
        for n, bx, by, w, h in boxes:
            inside = lambda p: bx <= p[0] <= bx + w and by <= p[1] <= by + h  # noqa: B023, E731
            if t in last:
                a, b = last[t], (x, y)
                steps = [(a[0] + (b[0] - a[0]) * k / 4000, a[1] + (b[1] - a[1]) * k / 4000) for k in range(4001)]
                how = "Inside" if inside(a) and inside(b) else "Entered" if inside(b) else "Left" if inside(a) else "Through" if any(map(inside, steps)) else None
                if how:
                    expected[seq, n] = how
        last[t] = (x, y)
    assert {k: v for k, v in found.items() if k in expected} == expected
    # A line that only grazes a corner can be missed by the sampled steps, not by the operator.
    assert len(found) - len(expected) <= 3


def test_boosted_scores_are_rounded_as_in_sql(spark):
    rows = [(1, 10, "p", 1, 1.06761), (1, 11, "p", 2, 0.1), (2, 10, "p", 1, -1.06761), (2, 11, "p", 2, -9.0)]
    scores = spark.createDataFrame(rows, "session long, candidate long, exit_node string, last_ts long, score double")
    con = duckdb.connect()
    expected = [con.execute(f"select round({s}::double * 1.15, 6)").fetchone()[0] for s in (1.06761, -1.06761)]
    assert [r.boosted for r in feature.best_candidates(scores).orderBy("session").collect()] == expected


def test_a_line_through_a_corner_meets_its_zone_as_in_sql(spark):
    ring = [(10.0, 10.0), (40.0, 10.0), (40.0, 40.0), (10.0, 40.0), (10.0, 10.0)]
    z = spark.createDataFrame([("A", ring)], "zone string, ring array<struct<x: double, y: double>>")
    df = log(spark, ("1", 1, 6.85, 33.0, 1, None, False), ("1", 2, 12.7, 46.0, 1, None, False), ("2", 1, 6.85, 33.0, 1, None, False), ("2", 2, 12.7, 46.01, 1, None, False))
    assert [(r.track_id, r.relation) for r in zones.zone_relations(tracks.lines(df), z).collect()] == [("1", "Through")]
    assert [(r.relation, r.zone) for r in zones.zone_events(tracks.lines(df), z).where("ts = 2").orderBy("track_id").collect()][:1] == [("Through", "A")]


def test_residents_are_sets(spark):
    """Entering twice counts once, passing through takes out, and a delete leaves every zone; as in the streaming form."""
    rows = [("n", "1", "A", 1, 0, "Entered"), ("n", "1", "A", 2, 1, "Entered"), ("n", "2", "A", 3, 2, "Entered"), ("n", "1", "A", 4, 3, "Through"), ("n", "1", "B", 5, 4, "Entered"), ("n", "2", None, 6, 5, "Deleted"), ("n", "3", "A", 7, 6, "Left"), ("n", "1", None, 8, 7, "Deleted")]
    events = spark.createDataFrame(rows, "node string, track_id string, zone string, ts bigint, seq bigint, relation string").withColumn("step", F.lit(0).cast("long"))
    found = [(r.zone, r.ts, r.change, r.residents) for r in zones.zone_residents(zones.stays(events), 3).orderBy("ts", "zone").collect()]
    assert found == [("A", 1, 1, 1), ("A", 3, 1, 2), ("A", 4, -1, 1), ("B", 5, 1, 1), ("A", 6, -1, 0), ("B", 8, -1, 0)]
    assert [tuple(r) for r in zones.residents_at(zones.stays(events), 5).orderBy("zone").collect()] == [("A", ["n[2]"], 1), ("B", ["n[1]"], 1)]


def test_numbers_in_order(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(40), i) for i in range(200)]
    found = sorted((r.k, r.place, r.ts, r.i) for r in windows.number_in_order(spark.createDataFrame(rows, "k string, ts bigint, i bigint"), "k", ["i"], bucket=7).collect())
    ordered = {k: sorted((ts, i) for x, ts, i in rows if x == k) for k in "ab"}
    assert found == [(k, n + 1, ts, i) for k in "ab" for n, (ts, i) in enumerate(ordered[k])]


def test_zone_events_and_residents(spark):
    ring = lambda x0, x1: [(x0, 0.0), (x1, 0.0), (x1, 9.0), (x0, 9.0), (x0, 0.0)]
    z = spark.createDataFrame([("A", ring(0.0, 2.0)), ("B", ring(3.0, 5.0)), ("C", ring(6.0, 9.0))], "zone string, ring array<struct<x: double, y: double>>")
    df = log(spark, ("1", 1, 1.0, 1.0, 1, None, False), ("1", 2, 7.0, 1.0, 1, None, False), ("1", 3, 8.0, 1.0, 1, None, False), ("1", 4, 0.0, 0.0, 1, None, True), ("2", 1, 2.5, 1.0, 1, None, False))
    events = zones.zone_events(tracks.lines(df), z)
    found = sorted((r.track_id, r.ts, r.step, r.relation, r.zone) for r in events.collect())
    assert [x[3:] for x in found] == [("Entered", "A"), ("Left", "A"), ("Through", "B"), ("Entered", "C"), ("Inside", "C"), ("Deleted", None), ("Unassigned", None)]
    left = [(r.zone, r.ts, r.residents) for r in zones.zone_residents(zones.stays(events), 2).orderBy("ts", "zone").collect()]
    assert left == [("A", 1, 1), ("A", 2, 0), ("C", 2, 1), ("C", 4, 0)]


def test_tracklets_of_a_whole_log_are_closed(spark, tmp_path):
    """The last tracklet has two features of five, and no delete says so."""
    rows = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    features = spark.createDataFrame([(t, i, i, [1.0]) for t, i in rows], "track long, ts long, seq long, feature array<double>")
    assert {r.track for r in feature.session_features(features, 3).collect()} == {1}
    assert sorted((r.track, r.seq) for r in feature.session_features(features, 3, whole=True).collect()) == rows
    vectors = spark.read.parquet(str(DATA / "embeddings.parquet")).where("vec_id < 62")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("feature_pair_topk", "feature_pair_dot"):
        assert {r.session for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} >= {11, 12}


def test_feature_choice(spark):
    rows = [(1, 10, "p", 5, 0.8), (1, 11, "p", 1, 0.75), (1, 12, "q", 1, 0.79)]
    scores = spark.createDataFrame(rows, "session long, candidate long, exit_node string, last_ts long, score double")
    assert feature.best_candidates(scores).select("candidate", "boosted").first() == (11, 0.8625)
    once = scores.withColumns({"first_ts": F.lit(1), "network": F.lit("n")})
    again = once.union(once.withColumn("session", F.lit(2).cast("long")).withColumn("first_ts", F.lit(2)))
    assert [(r.session, r.candidate) for r in feature.best_candidates_once(again).orderBy("session").collect()] == [(1, 11), (2, 10)]


def test_global_deletes_need_every_member(spark):
    df = spark.createDataFrame([("g", "a", 1, True), ("g", "b", 2, False), ("h", "c", 3, True)], "association string, tracklet string, ts bigint, is_deleted boolean")
    assert [tuple(r) for r in global_tracks.deletions(df).collect()] == [("h", 3, "DELETED")]


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    expected = con.execute(catalog.ORACLE_SQL[name]).df()
    found = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = lambda d: sorted(map(repr, (tuple(None if v != v else float(v) if isinstance(v, (int, float)) else str(v) for v in r) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False))))
    assert rows(found) == rows(expected)


def test_commands_build_tables(spark, tmp_path):
    from sightline.plans import commands

    wire = "node string, track_id string, state string, location array<double>, distance double, zone_expr string, first_ts bigint, ts bigint, seq bigint"
    rows = [("a", "1", "Confirmed", [1.0, 1.0], 1.0, "E(Z)", 0, 100, 0), ("b", "1", "Confirmed", [1.5, 1.0], 1.0, "U", 50, 150, 1), ("a", "1", "Deleted", None, 1.0, "D", 0, 300, 2)]
    spark.createDataFrame(rows, wire).write.parquet(str(tmp_path / "log"))
    (tmp_path / "areas.yml").write_text("hall:\n  bindings: [[a, b]]\n")
    commands.main(["build", "node_tracks_index", "--log", str(tmp_path / "log"), "--out", str(tmp_path / "index")])
    assert {(r.node, r.enter_zone, r.last_ts) for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {("a", "Z", 300), ("b", None, -1)}
    commands.main(["build", "associations", "--log", str(tmp_path / "log"), "--areas", str(tmp_path / "areas.yml"), "--out", str(tmp_path / "assoc")])
    assert [(r.id, r.tracklets, r.score) for r in spark.read.parquet(str(tmp_path / "assoc")).collect()] == [("a[1]", "a[1]-b[1]", 0.9)]
    seen = [("a", "1", [1.0, 0.0], 110, 0), ("c", "5", [0.1, 1.0], 9000, 1), ("a", "1", None, 300, 2), ("c", "5", None, 9900, 3)]
    spark.createDataFrame([("c", "5", "Confirmed", [7.0, 7.0], 1.0, "E(Y)", 8000, 8000, 3), ("c", "5", "Deleted", None, 1.0, "D", 8000, 9900, 4)], wire).write.mode("append").parquet(str(tmp_path / "log"))
    spark.createDataFrame(seen, "node string, track_id string, feature array<double>, ts bigint, seq bigint").write.parquet(str(tmp_path / "features"))
    (tmp_path / "links.yml").write_text("c:\n  Y:\n    - {coming_from: [a, Z], transition_time: [1s, 10s]}\n")
    commands.main(["build", "associations", "--log", str(tmp_path / "log"), "--areas", str(tmp_path / "areas.yml"), "--features", str(tmp_path / "features"), "--links", str(tmp_path / "links.yml"), "--out", str(tmp_path / "joint")])
    assert [(r.id, r.tracklets) for r in spark.read.parquet(str(tmp_path / "joint")).collect()] == [("a[1]", "a[1]-b[1]-c[5]")]
    commands.main(["format", "associations", "--out", str(tmp_path / "empty")])
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0


def test_ranges_and_texts_of_associations(spark):
    from sightline.functions import ids, ranges

    n, v = F.lit(None).cast("bigint"), F.lit
    row = spark.range(1).select(
        *(ranges.contains(r, v(5)) for r in (ranges.at_least(v(5)), ranges.at_most(v(4)), ranges.between(n, n), ranges.at(v(5)))), ranges.contains(ranges.at(v(5)), n),
        ranges.expand(ranges.between(n, n), v(7)), ranges.expand(ranges.at_least(v(3)), v(1)), ranges.expand(ranges.at(v(3)), n), ranges.order(ranges.at_least(v(3)), ranges.at(v(3))), ranges.order(ranges.at_most(v(3)), ranges.at(v(3))), ranges.span(ranges.at_most(v(9)), ranges.at(v(3))), ranges.side(ranges.between(n, n), v(1)),
        *ids.association_parts(v("cam-1[2]-cam-1[3]*-b[x-y]")), *ids.association_parts(v("a[1]")),
    ).first()
    assert list(row) == [True, False, True, True, None, (None, None), (1, 3), (None, None), 1, -1, (None, 9), 0, ["cam-1[2]", "cam-1[3]", "b[x-y]"], "cam-1[3]", ["a[1]"], None]


def test_commands_for_zones_and_logs_in_blocks(spark, tmp_path):
    from sightline.plans import commands

    wire = "node string, track_id string, state string, location array<double>, distance double, zone_expr string, first_ts bigint, ts bigint, seq bigint"
    at = lambda track, x, ts, seq: ("a", track, "Confirmed", [x, 1.0], 1.0, "U", 0, ts, seq)
    rows = [at("1", 1.0, 100, 0), at("2", 9.0, 110, 1), at("1", 5.0, 200, 2), at("2", 5.0, 210, 3), at("2", 9.5, 300, 4), ("a", "1", "Deleted", None, 1.0, "D", 0, 400, 5)]
    log, out = str(tmp_path / "log"), lambda name: str(tmp_path / name)
    spark.createDataFrame(rows, wire).write.parquet(log)
    (tmp_path / "zones.yml").write_text("Z: [[4, 0], [6, 0], [6, 2], [4, 2]]\n")
    for what in ("zone_events", "zone_residents"):
        commands.main(["build", what, "--log", log, "--zones", out("zones.yml"), "--out", out(what)])
    told = {(r.track_id, r.ts, r.relation, r.zone, r.added) for r in spark.read.parquet(out("zone_events")).collect()}
    assert {("1", 200, "Entered", "Z", False), ("2", 210, "Entered", "Z", False), ("2", 300, "Left", "Z", False), ("1", 400, "Left", "Z", True)} <= told
    assert [(r.ts, r.residents) for r in spark.read.parquet(out("zone_residents")).orderBy("ts").collect()] == [(200, 1), (210, 2), (300, 1), (400, 0)]
    commands.main(["build", "blocks", "--log", log, "--out", out("blocks")])
    commands.main(["replay", "blocks", "--log", out("blocks"), "--tracklets", "a[2] a[9] nobody", "--out", out("replayed")])
    assert sorted(r.seq for r in spark.read.parquet(out("replayed")).collect()) == [1, 3, 4]


def test_the_next_event_equals_a_plain_search(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(40) * 25, i) for i in range(120)] + [(None, 5, 200), (None, 400, 201)]
    df = spark.createDataFrame(rows, "k string, ts bigint, seq bigint")
    for ahead, bucket in ((0, 50), (100, 100), (330, 70), (90, 100_000)):
        found = {r.seq: r.later for r in windows.next_at_least(df, "k", ahead, out="later", bucket=bucket).collect()}
        assert found == {seq: min((t for n, t, _ in rows if n == k and t >= ts + ahead), default=None) for k, ts, seq in rows}
    assert windows.next_at_least(df.where("false"), "k", 10).collect() == []


def test_sets_that_hold_one_another_equal_all_pairs(spark):
    rng = random.Random(11)
    rows = [(i, sorted({f"{rng.choice('abcd')}[{rng.randrange(4)}]" for _ in range(rng.randrange(1, 6))}), rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tracklets array<string>, score double")
    assert {tuple(r) for r in A.holders(df, df).collect()} == {(i, j) for i, a, _ in rows for j, b, _ in rows if set(a) <= set(b)}
    shared = A.sharing(df, df).collect()
    assert len(shared) == len({(r.a, r.b) for r in shared}) and {(r.a, r.b) for r in shared} == {(i, j) for i, a, _ in rows for j, b, _ in rows if set(a) & set(b)}
    group = lambda i, a, s: type("G", (), {"tracklets": frozenset(a), "score": s})()
    above = {(j, i) for i, a, s in rows for j, b, v in rows if i != j and A.outranks(group(i, a, s), group(j, b, v))}
    assert {tuple(r) for r in A.superiors(df, df).collect()} == {(j, min(i for k, i in above if k == j)) for j, _ in above}
    keys = df.where("id < 5")
    assert {r.id for r in A.without_inferiors(df, keys).collect()} == {i for i, _, _ in rows} - {j for j, i in above if i < 5}


@pytest.mark.parametrize("inline", [64, 3, 0])
def test_relations_of_large_sets_equal_all_pairs(spark, monkeypatch, inline):
    """Sets within the bound are compared whole, of others the shared tracklets are counted; both as plain sets say."""
    monkeypatch.setattr(A, "INLINE", inline)
    rng = random.Random(11)
    sets = {f"s{i}": (sorted(rng.sample([f"c{n}[{t}]" for n in range(4) for t in range(4)], rng.randrange(1, 7))), rng.randrange(4) / 4) for i in range(40)}
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in sets.items()], "id string, tracklets array<string>, score double")

    def plain(a, b):
        left, right = set(a) - set(b), set(b) - set(a)
        node = lambda x: x.partition("[")[0]
        return "SAME" if not left | right else "LEFT_SUBSUME" if not right else "RIGHT_SUBSUME" if not left else "CONFLICT" if {*map(node, left)} & {*map(node, right)} else "MERGEABLE"

    expected = {(i, j): plain(a, b) for i, (a, _) in sets.items() for j, (b, _) in sets.items() if set(a) & set(b)}
    found = A.related(df, df).collect()
    assert {(r.a, r.b): r.relation for r in found} == expected and len(found) == len(expected)
    above = lambda i, j: expected.get((i, j)) == "LEFT_SUBSUME" or (sets[i][1] > sets[j][1] and (expected.get((i, j)) == "SAME" or expected.get((i, j)) == "CONFLICT" and len(sets[i][0]) >= len(sets[j][0])))
    best = {j: min(i for i in sets if above(i, j)) for j in sets if any(above(i, j) for i in sets)}
    assert {r.key: r.superior for r in A.superiors(df, df).collect()} == best
    assert sorted(map(tuple, A.holders(df, df).collect())) == sorted((i, j) for i, (a, _) in sets.items() for j, (b, _) in sets.items() if set(a) <= set(b))


def test_the_store_does_not_depend_on_the_order_of_rows():
    e = lambda a, b, s, ts: A.Edge(a, b, s, ts, ts, a)
    held = [A.Group([e("a[1]", "b[1]", 0.9, 1)]), A.Group([e("b[1]", "c[1]", 0.8, 2), e("c[1]", "d[1]", 0.7, 2)])]
    new = [A.Group([e("b[1]", "e[1]", 0.95, 5)])]
    told = lambda h: sorted((g.id, sorted(g.tracklets)) for g in stores.merge_into(h, new))
    assert told(held) == told(held[::-1])


def test_queries_have_rows(spark):
    for name in ("transition_candidates", "fully_closed", "assoc_relation", "assoc_superior", "assoc_holders", "delay_release"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1, name


def test_fully_closed_takes_whole_components_too(spark, tmp_path):
    # Three tracks that close in time, and three of which the last one doesn't: of them only the pair of the others is closed.
    rows = [(5, "10:00", 1), (6, "10:01", 1), (7, "10:02", 1), (10, "14:00", 1), (11, "14:01", 1), (12, "14:02", 1)]
    rows += [(u, "17:00" if u != 12 else "20:00", 60) for u, _, _ in rows]
    con = duckdb.connect()
    values = ", ".join(f"({i}::bigint, timestamp '2024-01-30 {at}:00', {u}::bigint, 'view', {v}::double, '{{\"k\": {v}}}')" for i, (u, at, v) in enumerate(rows))
    con.execute(f"copy (from (values {values}) e(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as from '{tmp_path}/events.parquet'")
    found = {tuple(r) for r in catalog.QUERIES["fully_closed"](spark, str(tmp_path)).collect()}
    assert found == {("cam:01[5]+cam:02[6]", 2), ("cam:02[6]+cam:03[7]", 2), ("c:cam:01[5]", 3), ("cam:01[10]+cam:02[11]", 2)}
    assert found == set(con.execute(catalog.ORACLE_SQL["fully_closed"]).fetchall())


def store_rows(spark, *groups):
    rows = [(g.id, sorted(g.tracklets), g.score, g.first_ts, g.ts, [(e.left, e.right, e.score, e.first_ts, e.ts, e.id) for e in sorted(g.supports, key=lambda e: (e.left, e.right))]) for g in groups]
    return spark.createDataFrame(rows, stores.ASSOCIATIONS)


def test_a_store_changes_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    e = lambda a, b, ts: A.Edge(*sorted((a, b)), round(rng.random(), 3), ts, ts, min(a, b))
    groups = [A.Group([e(f"a[{rng.randrange(5)}]", f"b[{rng.randrange(5)}]", ts)]) for ts in range(1, 13)]
    store = stores.AssociationStore(spark, str(tmp_path / "store"))
    assert store.read().count() == store.read("tracklets").count() == 0
    held: list = []
    for number in range(3):
        part = groups[4 * number : 4 * number + 4]
        held = stores.merge_into(held, part)
        if number == 1:
            before = sorted(map(tuple, store.read("tracklets").collect()))
            with monkeypatch.context() as m:
                m.setattr(stores.AssociationStore, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    store.put(number, store_rows(spark, *part))
            assert sorted(map(tuple, store.read("tracklets").collect())) == before
        assert store.put(number, store_rows(spark, *part[::-1]))
        assert not store.put(number, store_rows(spark, *part))
        assert sorted((r.id, r.tracklets) for r in store.read().collect()) == sorted((g.id, sorted(g.tracklets)) for g in held)
        latest = {t: g.id for g in sorted(held, key=lambda g: (g.ts, g.id)) for t in g.tracklets}
        assert dict(map(tuple, store.read("tracklets").collect())) == latest
    assert len(store.commits()) == 2


def test_a_store_follows_a_stream(spark, tmp_path):
    e = lambda a, b, ts: A.Edge(a, b, 0.5, ts, ts, a)
    one, two = A.Group([e("a[1]", "b[1]", 1)]), A.Group([e("b[1]", "c[1]", 2)])
    store_rows(spark, one, two).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = stores.AssociationStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(stores.ASSOCIATIONS).parquet(str(tmp_path / "in"))
    store.follow(stream, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(100)
    assert [r.tracklets for r in store.read().collect()] == [["a[1]", "b[1]", "c[1]"]]
