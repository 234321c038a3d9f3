"""Pairs of paths in blocks against the same pairs as rows, and components whose links are tied before."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import blocks, motion
from sightline.operators.components import connected_components

GATED = "area string, node string, track_id string, ts bigint, seq bigint, x double, y double, first_ts bigint, is_deleted boolean"
SIZE, ADVANCE, MOST = 1000, 500, 9.0


@pytest.fixture(scope="module")
def tables(spark):
    """Tracks of three cameras, of one to some points a window, some without a place; one camera is bound to itself, and two areas bind one pair."""
    rng, rows = random.Random(5), []
    for node in ("a", "b[x", "c"):
        for track in [*range(9), "x", "10"]:
            for _ in range(rng.randrange(1, 14)):
                y = None if rng.random() < 0.02 else float(rng.randrange(12))
                row = (node, str(track), rng.randrange(-800, 4000), len(rows), round(rng.random() * 25, 2), y, rng.randrange(5), rng.random() < 0.1)
                rows += [(area, *row) for area in ("hall", "yard") if area == "hall" or node != "c"]
    pairs = [("hall", "a", "b[x"), ("hall", "b[x", "c"), ("hall", "c", "c"), ("yard", "a", "b[x")]
    return spark.createDataFrame(rows, GATED), spark.createDataFrame(pairs, "area string, node1 string, node2 string")


@pytest.mark.parametrize("held", [2048, 3])
def test_blocks_give_what_rows_of_pairs_give(tables, monkeypatch, held):
    monkeypatch.setattr(blocks, "TRACKLETS", held)
    monkeypatch.setattr(blocks, "PAIRS", 40)
    gated, pairs = tables
    scored = motion.scored_pairs(motion.path_pairs(motion.window_paths(gated, SIZE, ADVANCE), pairs), MOST).localCheckpoint()
    names = ["left_id", "right_id", "score", "w_begin"]
    found = lambda keep, **only: blocks.pair_blocks(gated, pairs, SIZE, ADVANCE, MOST, keep, **only)
    told = lambda df: sorted(tuple(r) for r in df.select(*names).collect())
    # Both areas hold the same events, so a pair's rows of one window are equal.
    one = scored.distinct().drop("area").distinct()
    whole = found("best")
    assert told(whole) == told(motion.best_edges(one)) and whole.count() > 100
    columns = ["left_id", "right_id", "score", "id", "left_ts", "right_ts", "first_ts", "w_begin"]
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, motion.best_edges(one).select(*columns).collect()))
    newest = F.row_number().over(Window.partitionBy("left_id", "right_id").orderBy(F.desc("w_begin")))
    assert told(found("latest")) == told(one.withColumn("n", newest).where("n = 1"))
    before = F.max("score").over(Window.partitionBy("left_id", "right_id").orderBy("w_begin").rowsBetween(Window.unboundedPreceding, -1))
    assert told(found("rising")) == told(one.withColumn("b", before).where("b is null or score > b"))
    some = ["a[1]", "c[2]", "b[x[x]"]
    both = found("best", left_only=some).union(found("best", right_only=some, left_without=some))
    assert told(both) == told(motion.best_edges(one).where(F.col("left_id").isin(some) | F.col("right_id").isin(some)))
    of = lambda df, **how: sorted(tuple(r) for r in connected_components(df, "left_id", "right_id", **how).collect())
    assert of(found("links"), dense=True) == of(one)


def test_pairs_in_several_areas_are_one_edge(spark):
    rows = [(area, node, "1", ts, i, float(ts), 0.0, 0, False) for i, (area, node, ts) in enumerate([("hall", "a", 1), ("hall", "b", 3), ("yard", "a", 5), ("yard", "b", 5)])]
    pairs = spark.createDataFrame([("hall", "a", "b"), ("yard", "a", "b")], "area string, node1 string, node2 string")
    found = blocks.pair_blocks(spark.createDataFrame(rows, GATED), pairs, 10, 10, 4.0).collect()
    assert [(r.left_id, r.right_id, r.score, r.left_ts) for r in found] == [("a[1]", "b[1]", 1.0, 5)]


def test_tied_links_keep_loops_and_components(spark, monkeypatch):
    rng = random.Random(7)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(500, 500), (None, 3)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    plain = sorted(tuple(r) for r in connected_components(df).collect())
    assert sorted(tuple(r) for r in connected_components(df, dense=True).collect()) == plain and (500, 500) in plain
    assert connected_components(df.where("a < 0"), dense=True).count() == 0


def test_no_path_is_shuffled_for_each_of_its_pairs(spark, tables):
    """Edges of a pair of blocks leave their task whole: nothing is grouped after it."""
    plan = blocks.pair_blocks(*tables, SIZE, ADVANCE, MOST)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "FlatMapGroupsInArrow" in plan
