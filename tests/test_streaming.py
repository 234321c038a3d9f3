"""Streams over files give what batches give."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import indexes, windows
from sightline.sources import blocks, config, logs
from sightline.streaming import flows

SHAPE = "node string, ts bigint, seq bigint, x double, y double, is_deleted boolean"


def table(spark, path):
    rows = [("a", 100, 0, 1.0, 1.0, False), ("a", 400, 1, 3.0, 1.0, False), ("b", 450, 2, 5.0, 5.0, False), ("a", 1200, 3, 7.0, 1.0, False), ("a", 9000, 4, 0.0, 0.0, False)]
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def drained(query, name, mode="append"):
    query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return query.sparkSession.table(name)


def test_window_means_equal_the_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = windows.hopping(table(spark, path), 1000).groupBy("node", "w_begin").agg(F.avg("x").alias("x"))
    found = drained(flows.window_means(logs.stream_log(spark, path, SHAPE), "1 second"), "means")
    expected = {(r.node, r.w_begin, r.x) for r in batch.where("w_begin < 9000").collect()}
    assert {(r.node, r.w_begin, r.x) for r in found.collect()} == expected


def test_delay_line_releases_in_order(spark, tmp_path):
    path = str(tmp_path / "log")
    table(spark, path)
    found = drained(flows.delayed(logs.stream_log(spark, path, SHAPE), 1000), "delayed")
    assert [(r.node, r.seq) for r in found.orderBy("node", "ts").collect() if r.node == "a"][:3] == [("a", 0), ("a", 1), ("a", 3)]


TRACKS = "tracklet string, ts bigint, seq bigint, x double, y double, first_ts bigint, is_deleted boolean"


def batches(spark, path, shape, *files):
    """One file for each batch, in order of time."""
    import os
    import time

    for i, rows in enumerate(files):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("b"):
                os.rename(f"{path}/{f}", f"{path}/b{i}.parquet")
                os.utime(f"{path}/b{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)


def test_tracks_wait_for_their_association_and_give_up(spark, tmp_path):
    t = lambda name, ts, gone=False: (name, ts, ts, 1.0, 2.0, 0, gone)
    tracks = batches(spark, str(tmp_path / "t"), TRACKS, [t("a", 10), t("b", 20), t("c", 30)], [t("a", 40), t("b", 2000)], [t("b", 2500), t("a", 2600, True)], [t("z", 9000), t("b", 9100)], [t("z", 20_000)])
    shape = "tracklet string, association string, first_ts bigint, ts bigint"
    known = batches(spark, str(tmp_path / "a"), shape, [("x", "g0", 0, 5)], [("a", "g1", 7, 45)], [("x", "g0", 0, 50)], [("b", "g2", 3, 9000)], [("x", "g0", 0, 20_000)])
    found = drained(flows.associated(tracks, known, wait=1000, ttl=5000), "waiting").collect()
    of = {(r.tracklet, r.ts): (r.association, r.assoc_first_ts) for r in found}
    assert len(found) == len(of)
    assert of["a", 10] == of["a", 40] == of["a", 2600] == ("g1", 7)
    assert of["b", 20] == of["b", 2000] == ("b", 0) and of["c", 30] == ("c", 0)
    assert of["b", 9100] == ("g2", 3) and of["z", 9000] == of["z", 20_000] == ("z", 0)


def test_waiting_tracks_lose_nothing(spark, tmp_path):
    t = lambda name, ts: (name, ts, ts, float(ts), 2.0, 0, False)
    tracks = batches(spark, str(tmp_path / "t"), TRACKS, [t("a", 10), t("b", 20)], [t("a", 1500)], [t("a", 3000), t("b", 3010)], [t("a", 9000)], [t("a", 30_000)])
    shape = "tracklet string, association string, first_ts bigint, ts bigint"
    known = batches(spark, str(tmp_path / "a"), shape, [("x", "g0", 0, 5)], [("x", "g0", 0, 6)], [("b", "g1", 0, 3000)], [("x", "g0", 0, 9000)], [("x", "g0", 0, 30_000)])
    out = drained(flows.associated(tracks, known, wait=1000), "filled").collect()
    of = {(r.tracklet, r.ts): r.association for r in out}
    assert len(out) == len(of) and sorted(k for k in of if k[1] < 10_000) == [("a", 10), ("a", 1500), ("a", 3000), ("a", 9000), ("b", 20), ("b", 3010)]
    assert {v for k, v in of.items() if k[0] == "a"} == {"a"} and of["b", 3010] == "g1" and of["b", 20] in ("b", "g1")


def test_windows_close_when_the_source_is_idle(spark, tmp_path):
    rows = [("a", 100, 0, 1.0, 1.0, False), ("a", 400, 1, 3.0, 1.0, False), ("b", 450, 2, 5.0, 5.0, False), ("a", 1200, 3, 7.0, 1.0, False)]
    log = batches(spark, str(tmp_path / "log"), SHAPE, rows)
    query = flows.closing_windows(log, 1000, idle=500).writeStream.format("memory").queryName("closing").trigger(processingTime="300 milliseconds").start()
    for _ in range(40):
        query.awaitTermination(1)
        if spark.table("closing").count() >= 3:
            break
    query.stop()
    assert {(r.node, r.w_begin, r.x, r.n) for r in spark.table("closing").collect()} == {("a", 0, 2.0, 2), ("a", 1000, 7.0, 1), ("b", 0, 5.0, 1)}


def test_index_versions_are_partial_and_give_the_whole_index(spark, tmp_path):
    log, out = some_log(spark, 300), str(tmp_path / "index")
    for part in range(3):
        log.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    flows.upsert_index(logs.stream_log(spark, str(tmp_path / "log"), LOG, files=1), out, str(tmp_path / "c")).start().awaitTermination(120)
    versions = spark.read.parquet(out)
    assert versions.select("version").distinct().count() == 3 and versions.count() <= 3 * log.select("node", "track_id").distinct().count()
    assert same(flows.read_index(versions), indexes.track_index(log))


LOG = "node string, track_id string, ts bigint, seq bigint, x double, zone string, first_ts bigint, is_deleted boolean"


def some_log(spark, n, seed=5):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        t = rng.randrange(30)
        rows.append((f"cam:{t % 3}", str(t), seq // 2, seq, rng.random(), rng.choice(["A", "B", None]), t, rng.random() < 0.05))
    return spark.createDataFrame(rows, LOG)


def same(a, b):
    columns = sorted(b.columns)
    return sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


def test_a_replay_reads_the_blocks_of_its_keys_alone(spark, tmp_path):
    rare = F.col("seq").between(310, 314)
    log = some_log(spark, 1000).where("track_id <> '7' or seq between 310 and 314").withColumns({"node": F.when(rare, "cam:1").otherwise(F.col("node")), "track_id": F.when(rare, "7").otherwise(F.col("track_id")), "x": F.when(F.col("seq") % 9 > 0, F.col("x"))})
    held = blocks.BlockLog(spark, str(tmp_path / "log"), size=50)
    held.put(0, log.where("seq < 520"))
    held.put(1, log.where("seq >= 520"))
    assert same(held.track_index(), indexes.track_index(log)) and same(held.events().select(log.columns), log)
    lone = spark.createDataFrame([("cam:1", "7"), ("cam:1", None), (None, "7"), ("cam:9", "9")], "node string, track_id string")
    assert {(r.batch, r.block) for r in held.places(lone).collect()} == {(0, 6)}
    assert len(held.events(held.places(lone)).inputFiles()) == 1 and len(held.events().inputFiles()) == 21
    assert same(held.replay(lone).select(log.columns), log.where("node = 'cam:1' and track_id = '7'"))
    # Bounds of offsets: blocks outside aren't read, the ends are exact, -1 is the end of the log.
    spans = spark.createDataFrame([("cam:2", "2", 130, 270), ("cam:0", "3", 900, -1)], "node string, track_id string, first_offset bigint, last_offset bigint")
    wanted = log.where("(track_id = '2' and seq between 130 and 270) or (track_id = '3' and seq >= 900)")
    assert same(held.replay(spans).select(log.columns), wanted) and {r.block for r in held.places(spans).collect()} <= {2, 3, 4, 5, 18, 19}
    assert same(held.replay(held.track_index()).select(log.columns), indexes.replay(log, indexes.track_index(log), ["node", "track_id"]))
    near = held.between(149, 251)
    assert same(near.select(log.columns), log.where("seq between 149 and 251"))
    scanned = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in scanned
    assert held.replay(lone.limit(0)).count() == 0


def test_many_blocks_are_read_by_a_join(spark, tmp_path, monkeypatch):
    log = some_log(spark, 400)
    held = blocks.BlockLog(spark, str(tmp_path / "log"), size=20)
    held.put(0, log)
    keys = log.where("track_id in ('4', '5')").select("node", "track_id").distinct()
    few = held.replay(keys).collect()
    monkeypatch.setattr(blocks, "PATHS", 3)
    assert sorted(map(repr, held.replay(keys).select(*few[0].asDict()).collect())) == sorted(map(repr, few)) and len(few) > 20


def test_a_log_in_parts_repeated_batches_and_a_job_that_dies(spark, tmp_path, monkeypatch):
    # Offsets are those of parts: two parts have the same ones.
    log = some_log(spark, 300).withColumn("part", F.when(F.col("seq") % 3 > 0, F.col("seq") % 3)).withColumn("seq", F.floor(F.col("seq") / 3))
    held = blocks.BlockLog(spark, str(tmp_path / "log"), size=25)
    with pytest.raises(ValueError):
        held.index()
    held.put(0, log.where("seq < 60"))
    held.put(0, log.where("seq < 60"))
    names = [c for c in log.columns if c != "part"]
    assert same(held.events().select(names), log.where("seq < 60").select(names))
    monkeypatch.setattr(indexes, "partial_index", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        held.put(1, log.where("seq >= 60"))
    monkeypatch.undo()
    assert held.batches() == [0] and held.events().count() == log.where("seq < 60").count()
    held.put(1, log.where("seq >= 60"))
    assert same(held.between(30, 70, part=2).select(names), log.where("part = 2 and seq between 30 and 70").select(names))
    assert held.events().select("part").distinct().count() == 3
    with pytest.raises(Exception, match="no offset"):
        held.put(2, log.withColumn("seq", F.lit(None).cast("bigint")))
    with pytest.raises(ValueError, match="own"):
        held.put(2, log.withColumn("block", F.lit(1)))


def test_a_log_in_blocks_follows_a_stream(spark, tmp_path):
    log = some_log(spark, 300)
    for part in range(3):
        log.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = blocks.BlockLog(spark, str(tmp_path / "log"), size=64)
    held.follow(logs.stream_log(spark, str(tmp_path / "in"), LOG, files=1), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert held.batches() == [0, 1, 2] and same(held.events().select(log.columns), log) and same(held.track_index(), indexes.track_index(log))


def test_wire_form(spark):
    text = '{"node":"cam:01","track_id":"7","state":"Deleted","bbox":[1,2,3,4],"location":[5.0,9.5],"distance":31.2,"zone_expr":"E(A)","first_ts":1,"frame_index":2,"ts":3}'
    got = logs.as_tracks(logs.decode(spark.createDataFrame([(text, 4), ("no json", 5)], "value string, seq bigint"))).orderBy("seq").collect()
    assert (got[0].x, got[0].y, got[0].zone, got[0].is_deleted, got[0].seq) == (5.0, 9.5, "A", True, 4) and got[1].node is None
    back = logs.encode(spark.createDataFrame([("k", 1)], "id string, ts int"), F.col("id")).first()
    assert (back.key, back.value) == ("k", '{"id":"k","ts":1}')


def test_config(spark):
    c = config.load("motion: {window-size: 1s, window-advance: 500ms, max-distance: 8m}\nfeature: {top-percent: 0.15}")
    assert (c.motion.window, c.motion.advance, c.motion.most, c.feature.share, c.output.most_delay) == (1000, 500, 8.0, 0.15, 180_000)
    nodes, pairs = config.areas(spark, "hall:\n  bindings: [[b, a]]\n  distance_threshold: {a: 5m}")
    assert [tuple(r) for r in nodes.orderBy("node").collect()] == [("hall", "a", 5.0), ("hall", "b", None)] and pairs.first()[1:] == ("a", "b")
    assert config.zones(spark, "A: [[0, 0], [1, 0], [1, 1]]").first().ring[-1].x == 0.0
    assert config.links(spark, "n:\n  Z:\n    - {coming_from: [m, Y], transition_time: [1s, 3m]}").first() == ("n", "Z", "m", "Y", 1000, 180_000)
