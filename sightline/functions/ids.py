"""Text forms of tracklets, associations and zone relations, and the canonical form of an edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tracklet_id(node: Column, track: Column) -> Column:
    return F.concat(node, F.lit("["), track, F.lit("]"))


def tracklet_node(tracklet: Column) -> Column:
    """What stands before the last bracket."""
    return F.regexp_extract(tracklet, r"^(.*)\[([^\[]*)\]$", 1)


def tracklet_track(tracklet: Column) -> Column:
    return F.regexp_extract(tracklet, r"^(.*)\[([^\[]*)\]$", 2)


def tracklet_order(tracklet: Column) -> Column:
    """Node, then the track as a number; tracks that are none come first, by their text."""
    return F.struct(tracklet_node(tracklet).alias("node"), tracklet_track(tracklet).try_cast("bigint").alias("number"), tracklet_track(tracklet).alias("track"))


def association_text(tracklets: Column, leader: Column) -> Column:
    """Sorted tracklets joined by dashes, the leader with a star."""
    ordered = F.array_sort(F.transform(tracklets, lambda t: F.struct(tracklet_order(t).alias("o"), t.alias("t"))))
    return F.array_join(F.transform(ordered, lambda s: F.when(s["t"] == leader, F.concat(s["t"], F.lit("*"))).otherwise(s["t"])), "-")


def association_parts(text: Column) -> tuple[Column, Column]:
    """Tracklets and leader of an association's text; a dash parts tracklets only behind one's bracket, or its star, as nodes may have dashes. No star: no leader."""
    parts = F.split(text, r"(?<=\]|\]\*)-")
    starred = F.filter(parts, lambda p: F.endswith(p, F.lit("*")))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"\*$", "")), F.regexp_replace(F.get(starred, F.lit(0)), r"\*$", "")


def zone_text(relation: Column, zone: Column) -> Column:
    """U, D, or E, L, I, T with the zone in brackets."""
    letter = F.substring(relation, 1, 1)
    return F.when(relation.isin("Unassigned", "Deleted"), letter).otherwise(F.concat(letter, F.lit("("), zone, F.lit(")")))


def zone_relation(text: Column) -> Column:
    names = {"U": "Unassigned", "D": "Deleted", "E": "Entered", "L": "Left", "I": "Inside", "T": "Through"}
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.substring(text, 1, 1))


def zone_name(text: Column) -> Column:
    return F.when(F.instr(text, "(") > 0, F.regexp_extract(text, r"^.\((.*)\)$", 1))


def edge_ends(a: Column, b: Column) -> tuple[Column, Column]:
    """The smaller and the larger of two tracklets."""
    first = tracklet_order(a) <= tracklet_order(b)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def edge_leader(left: Column, left_first: Column, right: Column, right_first: Column) -> Column:
    """The end that was seen first; of equals the smaller tracklet, which is the left one."""
    return F.when(right_first < left_first, right).otherwise(left)
