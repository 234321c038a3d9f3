"""What tracks do in zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry, ids
from sightline.operators.tables import BROADCAST_BYTES, materialize


def line_relation(start_in: Column, stop_in: Column, meets: Column) -> Column:
    return F.when(start_in & stop_in, "Inside").when(stop_in, "Entered").when(start_in, "Left").when(meets, "Through")


def stripes(zones: DataFrame) -> tuple[DataFrame, float]:
    """Zones by stripes along x, as wide as the mean zone: each zone in every stripe that it touches, with its box and edges."""
    boxed = zones.select("zone", geometry.edges(F.col("ring")).alias("edges"), *(f(F.transform("ring", lambda p: p[c])).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.array_min), ("high", F.array_max))))  # noqa: B023
    width = boxed.agg(F.avg(F.col("highx") - F.col("lowx"))).first()[0] or 1.0
    cell = lambda c: F.floor(F.col(c) / width)
    return boxed.withColumn("first", cell("lowx")).withColumn("stripe", F.explode(F.sequence("first", cell("highx")))), width


def placed(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """Events of `lines` with each zone whose box they meet, in the first stripe that both touch: zone, s and e (whether it holds the start and the
    stop), crosses and d (how far from the start the line first meets an edge). Events stay, with a null zone, if they meet none in their first stripe.

    An equi-join on stripes; the exact predicates are computed once for each pair that is left.
    """
    parts, width = stripes(zones)
    low, high = (f(F.coalesce("x0", "x"), F.col("x")) for f in (F.least, F.greatest))
    first = F.floor(low / width)
    line = F.col("kind") == "line"
    nowhere = F.array(F.lit(None).cast("bigint"))
    cells = F.when(F.col("kind") == "deleted", nowhere).otherwise(F.coalesce(F.sequence(first, F.floor(high / width)), nowhere))
    dealt = lines.withColumns({"__first": first, "__stripe": F.explode(cells)})
    boxes = parts.select("stripe", F.col("first").alias("__z"), F.col("zone").alias("__zone"), "edges", "lowx", "highx", "lowy", "highy")
    y0 = F.coalesce("y0", "y")
    near = (F.col("__stripe") == F.col("stripe")) & (F.col("stripe") == F.greatest("__first", "__z")) & (high >= F.col("lowx")) & (low <= F.col("highx")) & (F.greatest(y0, F.col("y")) >= F.col("lowy")) & (F.least(y0, F.col("y")) <= F.col("highy"))
    joined = dealt.join(small_zones(boxes), near, "left").where(F.col("__zone").isNotNull() | F.col("__stripe").isNull() | (F.col("__stripe") == F.col("__first")))
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x").alias("x"), F.col("y").alias("y"))
    told = F.struct(
        (line & geometry.in_edges(a, F.col("edges"))).alias("s"),
        geometry.in_edges(b, F.col("edges")).alias("e"),
        (line & F.exists("edges", lambda e: meets(a, b, e))).alias("crosses"),
        F.when(line, entry_distance(a, b, F.col("edges"))).alias("d"),
    )
    # As a generator's output the predicates are columns, which the optimiser doesn't write out again wherever they are used.
    return joined.withColumn("__t", F.explode(F.array(F.when(F.col("__zone").isNotNull(), told)))).select(*[c for c in lines.columns if c != "zone"], F.col("__zone").alias("zone"), "__t.*")


def small_zones(boxes: DataFrame) -> DataFrame:
    """Broadcast within the bounds: edges count as an array of 128 bytes for each."""
    n, edges = boxes.agg(F.count("*"), F.coalesce(F.sum(F.size("edges")), F.lit(0))).first()
    return F.broadcast(boxes) if 128 * (n + edges) <= BROADCAST_BYTES else boxes


def zone_relations(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """Lines and each zone that they touch, with the relation. zones: zone, ring."""
    found = placed(lines.where("kind = 'line'"), zones)
    return found.withColumn("relation", line_relation(F.col("s"), F.col("e"), F.col("crosses"))).where("relation is not null").drop("s", "e", "crosses", "d")


def meeting(a: Column, b: Column, e: Column) -> Column:
    """How far from a, as a share of the way to b, the line meets an edge; null if it doesn't. On edges that are parallel to an axis the place is
    worked out from the one coordinate that they fix, as the SQL of the queries does, so that lines through a corner come out the same."""
    shares = []
    for fixed, free in (("x", "y"), ("y", "x")):
        t = (e["a"][fixed] - a[fixed]) / F.nullif(b[fixed] - a[fixed], F.lit(0.0))
        place = a[free] + t * (b[free] - a[free])
        hit = t.between(0, 1) & place.between(F.least(e["a"][free], e["b"][free]), F.greatest(e["a"][free], e["b"][free]))
        shares.append(F.when(hit, t))
    cross = F.nullif((b["x"] - a["x"]) * (e["b"]["y"] - e["a"]["y"]) - (b["y"] - a["y"]) * (e["b"]["x"] - e["a"]["x"]), F.lit(0.0))
    t = ((e["a"]["x"] - a["x"]) * (e["b"]["y"] - e["a"]["y"]) - (e["a"]["y"] - a["y"]) * (e["b"]["x"] - e["a"]["x"])) / cross
    u = ((e["a"]["x"] - a["x"]) * (b["y"] - a["y"]) - (e["a"]["y"] - a["y"]) * (b["x"] - a["x"])) / cross
    return F.when(e["a"]["x"] == e["b"]["x"], shares[0]).when(e["a"]["y"] == e["b"]["y"], shares[1]).when(t.between(0, 1) & u.between(0, 1), t)


def meets(a: Column, b: Column, e: Column) -> Column:
    level = (e["a"]["x"] == e["b"]["x"]) | (e["a"]["y"] == e["b"]["y"])
    return F.when(level, meeting(a, b, e).isNotNull()).otherwise(geometry.segments_cross(a, b, e["a"], e["b"]))


def entry_distance(a: Column, b: Column, edges: Column) -> Column:
    """How far from a, as a share of the way to b, the line first meets the edges."""
    return F.round(F.array_min(F.filter(F.transform(edges, lambda e: meeting(a, b, e)), lambda t: t.isNotNull())), 6)


def zone_events(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """One event for each zone that a line touches, in order: left, passed through (by distance from the start), entered.

    A line in one zone gives its event as it is; of several zones, those it stays inside give none. Points are entered (in the first of several
    zones) or unassigned; deletes are deleted. step numbers the events of a line. Windows are within an event, whose rows lie where the lines of
    its track do, so nothing is shuffled beyond what the lines are.
    """
    line, point = F.col("kind") == "line", F.col("kind") == "point"
    relation = F.when(line, line_relation(F.col("s"), F.col("e"), F.col("crosses"))).when(point & F.col("e"), "Entered")
    event = Window.partitionBy("node", "track_id", "seq")
    related = placed(lines, zones).withColumn("relation", relation).withColumn("n", F.count("relation").over(event))
    kept = related.where((line & F.col("relation").isNotNull() & ((F.col("n") == 1) | (F.col("relation") != "Inside"))) | (point & ((F.col("n") == 0) | F.col("relation").isNotNull())) | (F.col("kind") == "deleted"))
    place = F.when(F.col("relation") == "Left", 0).when(F.col("relation") == "Through", 1).otherwise(2)
    step = (F.row_number().over(event.orderBy(place, "d", "zone")) - 1).cast("long")
    told = F.when(F.col("kind") == "deleted", "Deleted").when(point & F.col("relation").isNull(), "Unassigned").otherwise(F.col("relation"))
    events = kept.select("node", "track_id", "ts", "seq", "kind", step.alias("step"), told.alias("relation"), F.when(F.col("relation").isNotNull(), F.col("zone")).alias("zone"))
    return events.where(line | (F.col("step") == 0)).drop("kind")


def stays(events: DataFrame) -> DataFrame:
    """Changes of which track is in which zone: node, track_id, zone, ts, seq, step, change (1 or -1).

    For each track and zone the state after an event is whether the track is in: entering puts it in, leaving, passing through and the track's
    delete take it out of every zone it has been in. What changes nothing gives no row. Windows are within a track.
    """
    moves = events.where(F.col("relation").isin("Entered", "Left", "Through", "Deleted"))
    been = F.collect_set("zone").over(Window.partitionBy("node", "track_id"))
    spread = moves.withColumn("__been", been).withColumn("zone", F.explode(F.when(F.col("relation") == "Deleted", F.col("__been")).otherwise(F.array("zone"))))
    order = Window.partitionBy("node", "track_id", "zone").orderBy("ts", "seq", "step")
    state = (F.col("relation") == "Entered").cast("int")
    found = spread.withColumn("state", state).withColumn("change", F.col("state") - F.coalesce(F.lag("state").over(order), F.lit(0)))
    return found.where("change <> 0").select("node", "track_id", "zone", "ts", "seq", "step", "change")


def with_exits(events: DataFrame) -> DataFrame:
    """Zone events, and before a track's delete a Left for each zone that it is in still: added (whether the row is such a one) and valid.

    valid: whether the event agrees with the events before it. A track enters and passes through zones that it isn't in, and leaves and stays inside
    zones that it is in. Windows are within a track.
    """
    relation, key = F.col("relation"), ["node", "track_id", "seq"]
    before = Window.partitionBy("node", "track_id", "zone").orderBy("ts", "seq", "step").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(relation == "Entered", 1).when(relation.isin("Left", "Through"), 0)
    inside = F.coalesce(F.last("__state", ignorenulls=True).over(before), F.lit(0)) == 1
    valid = F.when(relation.isin("Entered", "Through"), ~inside).when(relation.isin("Left", "Inside"), inside).otherwise(True)
    told = events.withColumn("__state", state).withColumns({"added": F.lit(False), "valid": valid}).drop("__state")
    ended = events.where("relation = 'Deleted'").select(*key)
    left = stays(events).where("change = -1").join(ended, key).withColumns({"relation": F.lit("Left"), "added": F.lit(True), "valid": F.lit(True)})
    return told.unionByName(left.select(*told.columns))


def zone_residents(changes: DataFrame, bucket: int = 86_400_000) -> DataFrame:
    """Number of tracks in each zone after each change, in order of time.

    The running sum is taken within (zone, bucket of time) and started from the sums of earlier buckets, so no zone's whole history is one task's.
    """
    dealt = materialize(changes).withColumn("__b", F.floor(F.col("ts") / bucket))
    totals = dealt.groupBy("zone", "__b").agg(F.sum("change").alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.partitionBy("zone").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy("zone", "__b").orderBy("ts", "seq", "step", "node", "track_id")
    running = dealt.withColumn("__r", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return running.join(totals.withColumn("__s", before).drop("__t"), ["zone", "__b"]).withColumn("residents", F.col("__s") + F.col("__r")).drop("__b", "__r", "__s")


def residents_at(changes: DataFrame, ts: int) -> DataFrame:
    """The tracks in each zone at a time: zone, tracks (node and track as one id, sorted), residents."""
    held = changes.where(F.col("ts") <= ts).groupBy("zone", "node", "track_id").agg(F.sum("change").alias("n")).where("n > 0")
    return held.groupBy("zone").agg(F.array_sort(F.collect_list(ids.tracklet_id(F.col("node"), F.col("track_id")))).alias("tracks"), F.count("*").alias("residents"))
