"""Streams with keyed states against what batches give."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import aggregation, feature, global_tracks, windows, zones
from sightline.streaming import anchored, arrivals, publication, residents, sessions
from tests.test_streaming import batches, drained

TRACKS = "lane string, tracklet string, ts bigint, seq bigint, x double, y double, first_ts bigint, is_deleted boolean"
KNOWN = "lane string, tracklet string, association string, first_ts bigint, members string, ts bigint"


@pytest.fixture(autouse=True)
def states(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": publication.PROVIDER, "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def parts(rows, n, rng):
    """Rows dealt into n batches, roughly in order of time."""
    rows = sorted(rows, key=lambda r: r[2] + rng.randrange(80))
    return [rows[len(rows) * i // n : len(rows) * (i + 1) // n] for i in range(n)]


def test_global_tracks_come_in_order_and_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    members = {"g1": ["a[1]", "b[1]"], "g2": ["a[2]"], "g3": ["b[3]", "c[3]", "a[3]"]}
    of = {t: g for g, ts in members.items() for t in ts}
    rows = []
    for lane in ("north", "south"):
        for i, t in enumerate([*of, "c[9]"]):
            start = 100 * i
            for ts in range(start, start + 1500, 60 + i):
                rows.append((lane, t, ts, 0, rng.random(), rng.random(), start, False))
            rows.append((lane, t, start + 1500, 0, 0.0, 0.0, start, True))
        rows.append((lane, "z[1]", 9000, 0, 0.0, 0.0, 9000, False))
    rows = [(*r[:3], i, *r[4:]) for i, r in enumerate(rows)]
    late = [(lane, t, g, 7, " ".join(members[g]), 0) for lane in ("north", "south") for t, g in of.items()]
    tracks = batches(spark, str(tmp_path / "t"), TRACKS, *parts(rows, 6, rng))
    # Associations come batches after their tracks.
    known = batches(spark, str(tmp_path / "a"), KNOWN, [("north", "x", "x", 0, "x", 0)], [("north", "x", "x", 0, "x", 0)], late[:3], late[3:8], late[8:], [("north", "x", "x", 0, "x", 0)])
    found = drained(publication.published(tracks, known, interval=100, grace=200, wait=3000), "published").collect()
    for lane in ("north", "south"):
        told = sorted((r for r in found if r.lane == lane), key=lambda r: r.place)
        assert [r.place for r in told] == list(range(len(told)))
        assert [r.w_begin for r in told] == sorted(r.w_begin for r in told)
        log = spark.createDataFrame([r for r in rows if r[0] == lane and r[1] != "z[1]"], TRACKS)
        given = spark.createDataFrame([(t, g, 7) for t, g in of.items()], "tracklet string, association string, first_ts bigint")
        enriched = global_tracks.enrich(log, given)
        columns = ["association", "w_begin", "x", "y", "ts", "first_ts", "n_supports", "n_tracklets", "state"]
        want = {tuple(r[c] for c in columns) for r in global_tracks.global_tracks(enriched, 100).collect()}
        near = lambda r: (*r[:2], round(r[2], 4), round(r[3], 4), *r[4:])
        assert {near(tuple(r[c] for c in columns)) for r in told if r.state != "DELETED"} == {near(w) for w in want}
        assert {(r.association, r.ts) for r in told if r.state == "DELETED"} == {(r.association, r.ts) for r in global_tracks.deletions(enriched).collect()}


def test_the_first_window_holds_those_behind_it(spark, tmp_path):
    t = lambda name, ts: ("l", name, ts, ts, 1.0, 1.0, 0, False)
    tracks = batches(spark, str(tmp_path / "t"), TRACKS, [t("a", 10), t("b", 20)], [t("a", 400), t("b", 410)], [t("a", 900)], [t("b", 2000)])
    known = batches(spark, str(tmp_path / "a"), KNOWN, [("l", "a", "g", 0, "a", 0)], [("l", "q", "q", 0, "q", 0)], [("l", "q", "q", 0, "q", 0)], [("l", "q", "q", 0, "q", 0)])
    found = drained(publication.published(tracks, known, interval=100, grace=0, wait=1000), "blocked").orderBy("place").collect()
    # b is unknown until it has waited for 1,000: nothing leaves before, then everything in order.
    assert [(r.association, r.w_begin, r.state) for r in found] == [("b", 0, "ISOLATED"), ("g", 0, "ASSOCIATED"), ("b", 400, "ISOLATED"), ("g", 400, "ASSOCIATED"), ("g", 900, "ASSOCIATED")]


def test_a_silent_source_is_published_to_the_end(spark, tmp_path):
    t = lambda name, ts: ("l", name, ts, ts, 1.0, 1.0, 0, False)
    tracks = batches(spark, str(tmp_path / "t"), TRACKS, [t("a", 10), t("b", 120)])
    known = batches(spark, str(tmp_path / "a"), KNOWN, [("l", "a", "g", 0, "a", 0)])
    query = publication.published(tracks, known, idle=500).writeStream.format("memory").queryName("silent").trigger(processingTime="300 milliseconds").start()
    for _ in range(40):
        query.awaitTermination(1)
        if spark.table("silent").count() >= 2:
            break
    query.stop()
    assert [(r.association, r.w_begin) for r in spark.table("silent").orderBy("place").collect()] == [("g", 0), ("b", 100)]


def test_residents_of_the_stream_equal_the_batch_with_deletes(spark, tmp_path):
    rng, rows = random.Random(6), []
    for track in range(12):
        inside = set()
        for k in range(9):
            zone = rng.choice("ABC")
            relation = rng.choice(["Left", "Inside"]) if zone in inside else rng.choice(["Entered", "Entered", "Through"])
            (inside.add if relation == "Entered" else inside.discard if relation == "Left" else lambda z: None)(zone)
            rows.append((zone, str(track), relation, 100 * k + track))
        if track % 3:
            rows.append((None, str(track), "Deleted", 1000 + track))
    rows = [(*r, i) for i, r in enumerate(sorted(rows, key=lambda r: r[3]))]
    shape = "zone string, track string, relation string, ts bigint, seq bigint"
    events = batches(spark, str(tmp_path / "events"), shape, rows[:40], rows[40:80], rows[80:])
    changes = residents.zone_changes(events)
    changes.writeStream.format("parquet").option("path", str(tmp_path / "changes")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(100)
    table = spark.read.parquet(str(tmp_path / "changes"))
    batch = zones.stays(spark.createDataFrame(rows, shape).withColumns({"node": F.lit("n"), "track_id": F.col("track"), "step": F.lit(0)}))
    assert {tuple(r) for r in table.collect()} == {(r.zone, r.track_id, r.change, r.ts, r.seq) for r in batch.collect()}
    assert {(r.zone, r.track) for r in residents.residents(table).collect()} == {(r.zone, t[2:-1]) for r in zones.residents_at(batch, 10_000).collect() for t in r.tracks}
    counted = drained(residents.zone_residents(spark.readStream.schema(residents.CHANGES).parquet(str(tmp_path / "changes"))), "counted").collect()
    assert {(r.zone, r.track, r.seq): r.residents for r in counted} == {(r.zone, r.track_id, r.seq): r.residents for r in zones.zone_residents(batch).collect()}


def test_sessions_of_the_stream_equal_the_batch_with_deletes(spark, tmp_path):
    rng = random.Random(2)
    links = [("b", "in", "a", "out", 0, 3000), ("c", "in", "b", "out", 0, 3000), ("c", "in", "a", "out", 500, 5000)]
    features, index, spans = [], [], []
    for track in range(30):
        node, start, n = "abc"[track % 3], 400 * track + rng.randrange(300), rng.randrange(2, 8)
        times = [start + 60 * k for k in range(n)]
        for ts in times:
            v = [rng.gauss(0, 1) for _ in range(4)]
            size = sum(x * x for x in v) ** 0.5
            features.append(("net", node, track, [x / size for x in v], ts, ts))
        # One in seven is never deleted; some of those have too few features, and hold nobody for ever.
        if track % 7:
            features.append(("net", node, track, None, times[-1] + 10, times[-1] + 10))
        last = times[-1] + 10 if track % 7 else -1
        index += [("net", node, track, "in", None, -1, start), ("net", node, track, "in", "out", last, times[-1] + 10)]
        spans.append((node, track, "in", "out", start, last))
    end = ("net", "a", 99, None, 60_000, 60_000)
    shape = "network string, node string, track bigint, feature array<float>, ts bigint, seq bigint"
    zone_shape = "network string, node string, track bigint, enter_zone string, exit_zone string, last_ts bigint, ts bigint"
    cut = lambda rows, k: [[r for r in rows if 3000 * i <= r[k] < 3000 * (i + 1)] for i in range(5)]
    stream = batches(spark, str(tmp_path / "f"), shape, *cut(features, 4), [end])
    zone_stream = batches(spark, str(tmp_path / "z"), zone_shape, *cut(index, 6), [("net", "a", 99, None, None, -1, 60_000)])
    found = drained(sessions.matches(stream, zone_stream, links, ttl=5000), "matched").collect()

    log = spark.createDataFrame([r[1:] for r in features], "node string, track bigint, feature array<float>, ts bigint, seq bigint")
    table = spark.createDataFrame(spans, "node string, track bigint, enter_zone string, exit_zone string, first_ts bigint, last_ts bigint")
    ties = spark.createDataFrame(links, "enter_node string, enter_zone string, exit_node string, exit_zone string, min_ms bigint, max_ms bigint")
    pairs = feature.transition_candidates(table.withColumnRenamed("track", "session"), ties, table.select("node", "track", "exit_zone", "last_ts"), 3000)
    scores = feature.pair_scores(pairs.select("session", "candidate"), feature.session_features(log)).join(pairs, ["session", "candidate"])
    told = scores.join(table.select(F.col("track").alias("session"), "first_ts"), "session").withColumn("network", F.lit("net"))
    want = {(r.session, r.candidate, r.exit_node): r.boosted for r in feature.best_candidates_once(told).collect()}
    got = {(r.session, r.candidate, r.exit_node): r.boosted for r in found}
    assert len(want) >= 10 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


PLACES = "node string, ts bigint, seq bigint, x double, y double"


def test_anchored_windows_equal_the_batch_in_order(spark, tmp_path):
    rng = random.Random(9)
    rows, at = [], {"a": 0, "b": 70}
    for i in range(240):
        node = rng.choice("ab")
        at[node] += rng.choice([1, 9, 30, 30, 60, 400])
        rows.append((node, at[node], i, rng.random(), 5e6 + rng.random()))
    ends = [(node, None, 900, None, None) for node in "ab"]
    stream = batches(spark, str(tmp_path / "p"), PLACES, rows[:70], rows[70:75], rows[75:], ends)
    for aggregator in (aggregation.Spread(), aggregation.Extent()):
        found = drained(anchored.anchored_windows(stream, "node", 100, 30, aggregator), f"anchored_{type(aggregator).__name__}")
        batch = windows.reanchored(spark.createDataFrame(rows, PLACES), 100, 30, ["node"])
        want = aggregation.aggregated(batch, ["node", "w_begin"], aggregator)
        near = lambda d: sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in d.collect())
        assert near(found) == near(want) and found.count() > 100


def test_late_events_count_while_a_window_is_open(spark, tmp_path):
    first = [("a", 1000, 0, 1.0, 0.0), ("a", 1090, 1, 1.0, 0.0), ("a", 1010, 2, 1.0, 0.0), ("a", 990, 3, 1.0, 0.0)]
    # 1130 is within the grace of the first window's end, so 1050 still counts in it; 1160 closes it, and 1060 is for its successor alone.
    second = [("a", 1130, 4, 1.0, 0.0), ("a", 1050, 5, 1.0, 0.0), ("a", 1160, 6, 1.0, 0.0), ("a", 1060, 7, 1.0, 0.0), ("a", None, 8, None, None), ("a", 2000, 9, 1.0, 0.0)]
    stream = batches(spark, str(tmp_path / "p"), PLACES, first, second, [("a", None, 10, None, None)])
    found = drained(anchored.anchored_windows(stream, "node", 100, 50, aggregation.Spread(), grace=50), "late_ones")
    assert sorted((r.w_begin, r.n) for r in found.collect()) == [(1000, 4), (1050, 4), (1100, 2), (1150, 1), (2000, 1)]


def test_aggregators_take_null_keys_and_many_partials(spark):
    rows = [(None if i % 3 == 0 else "a" if i % 3 == 1 else "b", i, 0, float(i), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, PLACES).repartition(7)
    found = {r.node: (r.n, r.x, r.spread) for r in aggregation.aggregated(df.select("node", "x", "y"), ["node"], aggregation.Spread(), 2).collect()}
    for node in (None, "a", "b"):
        xs = [r[3] for r in rows if r[0] == node]
        mean = sum(xs) / len(xs)
        assert found[node] == (100, round(mean, 4), round((sum((x - mean) ** 2 for x in xs) / 100) ** 0.5, 4))
    assert aggregation.aggregated(df.where("false"), ["node"], aggregation.Spread()).count() == 0


def test_spread_rounds_and_passes_over_nulls_as_sql_does(spark):
    # Means at halves of the last digit, on either side of zero; a row, and a key, without a coordinate.
    rows = [("half", 0, 0, x, y) for x, y in ((0.0, 0.0), (0.0625, -0.0625))]
    rows += [("hole", 0, 0, 1.0, None), ("hole", 0, 0, 2.5, 4.0), ("hole", 0, 0, None, 8.0), ("none", 0, 0, None, 3.0), (None, 0, 0, 7.0, 7.0)]
    con = duckdb.connect()
    con.execute("create table t (node text, x double, y double)")
    con.executemany("insert into t values (?, ?, ?)", [(r[0], r[3], r[4]) for r in rows])
    want = con.execute("select node, count(*), round(avg(x), 4), round(avg(y), 4), round(sqrt(var_pop(x) + var_pop(y)), 4) from t group by node").fetchall()
    found = aggregation.aggregated(spark.createDataFrame(rows, PLACES).repartition(3).select("node", "x", "y"), ["node"], aggregation.Spread(), 2)
    assert ("half", 2, 0.0313, -0.0313, 0.0442) in want
    assert {tuple(r) for r in found.collect()} == set(want)


def test_means_do_not_depend_on_how_rows_are_dealt():
    rng, spread = random.Random(3), aggregation.Spread()
    xs = [12.75, 26.29, 11.91, 2.04, 42.41, 32.04, 48.25, 32.96]
    for _ in range(200):
        rng.shuffle(xs)
        cut = rng.randrange(1, 8)
        parts = [spread.partial(pd.DataFrame({"k": [None] * len(p), "x": p, "y": 0.0}), ["k"]) for p in (xs[:cut], xs[cut:])]
        merged = spread.merge(pd.concat(parts), ["k"])
        assert merged.x.tolist() == [math.fsum(xs)]
        assert spread.close(merged).x.tolist() == [26.0813]


def plain_spans(rows, span):
    """Begin of each (lane, ts, seq), walked one by one."""
    first, found = {}, {}
    for lane, ts, seq in sorted(rows, key=lambda r: r[1:]):
        if lane not in first or ts >= first[lane] + span:
            first[lane] = ts
        found[lane, seq] = first[lane]
    return found


@pytest.mark.parametrize("step", [3, 40, 300])
def test_spans_of_arrival_equal_a_plain_walk(spark, step):
    rng, ts, rows = random.Random(step), 0, []
    for seq in range(400):
        # Ties, silences longer than a span and than a bucket, a null lane and times before zero.
        ts += rng.choice([0, rng.randrange(step), rng.randrange(step), 0 if rng.random() < 0.97 else 5000])
        rows.append((rng.choice(["n", "s", None]), ts - 700, seq))
    log = spark.createDataFrame([(*r, [1, None]) for r in rows] + [("n", None, 999, [])], "lane string, ts bigint, seq bigint, w_begin_of array<int>")
    found = windows.arrival_spans(log, 100, ["lane"], bucket=250)
    assert found.columns == [*log.columns, "w_begin"]
    assert {(r.lane, r.seq): r.w_begin for r in found.collect()} == plain_spans(rows, 100)
    assert windows.arrival_spans(log.limit(0), 100, ["lane"]).count() == 0


ENRICHED = "lane string, " + ", ".join(f"{c} {t}" for c, t in arrivals.EVENT.items())


def enriched_rows():
    rng, rows = random.Random(8), []
    members = {"g1": ["a[1]", "b[1]"], "g2": ["a[2]", "b[2]", "c[2]"], "a[5]": ["a[5]"]}
    for lane in ("north", "south"):
        for g, ts in members.items():
            for i, t in enumerate(ts):
                for at in range(50 * i, 1200 + 90 * i, 37 + i):
                    rows.append((lane, t, g, g != t, len(ts), 3, 50 * i, at, 0, rng.random(), rng.random(), False))
                if (lane, t) != ("south", "b[2]"):
                    rows.append((lane, t, g, g != t, len(ts), 3, 50 * i, 1250 + 90 * i, 0, None, None, True))
    rows.sort(key=lambda r: (r[7], r[1], r[0]))
    return [(*r[:8], i, *r[9:]) for i, r in enumerate(rows)]


def test_global_tracks_by_arrival_equal_the_batch(spark, tmp_path):
    rows = enriched_rows()
    rows.append(("north", "z[1]", "z[1]", False, 1, 9000, 9000, 9000, 9999, 0.0, 0.0, False))
    rows.append(("south", "z[1]", "z[1]", False, 1, 9000, 9000, 9000, 9998, 0.0, 0.0, False))
    stream = batches(spark, str(tmp_path / "t"), ENRICHED, *[rows[len(rows) * i // 5 : len(rows) * (i + 1) // 5] for i in range(5)])
    found = []
    arrivals.global_tracks_by_arrival(stream, lambda out, number: found.extend(out.collect()), str(tmp_path / "c"), 100).trigger(availableNow=True).start().awaitTermination(120)
    batch = global_tracks.in_arrival_spans(spark.createDataFrame(rows, ENRICHED), 100).where("w_begin < 9000").collect()
    near = lambda r: (r.lane, r.w_begin, r.association, r.state, r.x and round(r.x, 4), r.y and round(r.y, 4), r.first_ts, r.ts, r.n_supports)
    assert sorted(map(repr, map(near, found))) == sorted(map(repr, map(near, batch)))
    assert {(r.lane, r.association) for r in found if r.state == "DELETED"} == {("north", "g1"), ("north", "g2"), ("north", "a[5]"), ("south", "g1"), ("south", "a[5]")}
    assert {r.state for r in found if r.association == "a[5]"} == {"ISOLATED", "DELETED"}


def test_a_span_leaves_when_its_lane_is_silent(spark, tmp_path):
    t = lambda name, ts: ("l", name, name, False, 1, ts, ts, ts, ts, 1.0, 1.0, False)
    stream = batches(spark, str(tmp_path / "t"), ENRICHED, [t("a", 10), t("b", 90), t("c", 200)])
    query = arrivals.spans(stream, 100, idle=500).writeStream.format("memory").queryName("spans").trigger(processingTime="300 milliseconds").start()
    for _ in range(40):
        query.awaitTermination(1)
        if spark.table("spans").count() >= 3:
            break
    query.stop()
    assert sorted((r.tracklet, r.w_begin) for r in spark.table("spans").collect()) == [("a", 10), ("b", 10), ("c", 200)]


def test_tracks_outside_of_overlapping_views_pass_one_by_one(spark):
    rows = [(None, "d[1]", "g1", True, 2, 3, 40, 50, 1, 1.5, 2.5, False), (None, "d[2]", "d[2]", False, 1, 60, 60, 60, 2, 3.0, 4.0, False), (None, "d[1]", "g1", True, 2, 3, 40, 70, 3, 1.0, 1.0, True)]
    found = global_tracks.in_arrival_spans(spark.createDataFrame(rows, ENRICHED), 100).orderBy("ts").collect()
    assert [tuple(r)[1:] for r in found] == [(50, "g1", "ASSOCIATED", 1.5, 2.5, 40, 50, 1), (60, "d[2]", "ISOLATED", 3.0, 4.0, 60, 60, 1), (70, "d[1]", "DELETED", None, None, 40, 70, 0)]
