"""Ranges with both ends included, as structs of low and high; a null end is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(low: Column, high: Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"))


def at_least(low: Column) -> Column:
    return between(low, F.nullif(low, low))


def at_most(high: Column) -> Column:
    return between(F.nullif(high, high), high)


def at(value: Column) -> Column:
    return between(value, value)


def contains(of: Column, value: Column) -> Column:
    """Whether a value lies in a range; null for a null value."""
    low, high = of["low"], of["high"]
    return F.when(value.isNotNull(), (low.isNull() | (low <= value)) & (high.isNull() | (high >= value)))


def _both(pick, a: Column, b: Column) -> Column:
    """The least or the greatest of two ends; open if one of them is."""
    return F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


def expand(of: Column, value: Column) -> Column:
    """A range that reaches to a value, too. An open low end stays open; an open high end is taken to be the low one, so it closes unless both are
    open. A null value opens both ends."""
    return between(_both(F.least, of["low"], value), _both(F.greatest, F.coalesce(of["high"], of["low"]), value))


def span(a: Column, b: Column) -> Column:
    """The smallest range over two; an end that is open in one of them is open."""
    return between(_both(F.least, a["low"], b["low"]), _both(F.greatest, a["high"], b["high"]))


def order(a: Column, b: Column) -> Column:
    """-1, 0 or 1, by low ends, then high ends; open low ends come first, open high ends last."""
    lows = F.struct(a["low"].isNotNull(), a["low"]), F.struct(b["low"].isNotNull(), b["low"])
    highs = F.struct(a["high"].isNull(), a["high"]), F.struct(b["high"].isNull(), b["high"])
    left, right = F.struct(lows[0].alias("l"), highs[0].alias("h")), F.struct(lows[1].alias("l"), highs[1].alias("h"))
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def side(of: Column, value: Column) -> Column:
    """1 if a range lies behind a value, -1 if before it, 0 if it holds it; null for a null value."""
    return F.when(value.isNull(), None).when(of["low"] > value, 1).when(of["high"] < value, -1).otherwise(0)
