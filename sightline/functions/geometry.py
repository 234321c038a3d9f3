"""Points, paths, rings and projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2.0) + F.pow(a["y"] - b["y"], 2.0))


def path_alignment(longer: Column, shorter: Column, digits: int = 6) -> Column:
    """Slide the shorter path along the longer: struct of d, the least mean distance of points (rounded), and o, the first offset that has it."""
    n = F.size(shorter)
    mean = lambda o: F.aggregate(F.zip_with(F.slice(longer, o + 1, n), shorter, distance), F.lit(0.0), lambda s, d: s + d) / n
    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(longer) - n), lambda o: F.struct(F.round(mean(o), digits).alias("d"), o.alias("o"))))


def closest_points(longer: Column, shorter: Column, offset: Column, digits: int = 6) -> Column:
    """struct of d and i: the position in the shorter path of the closest pair of an alignment."""
    pair = lambda i: F.struct(F.round(distance(F.get(longer, offset + i), F.get(shorter, i)), digits).alias("d"), i.alias("i"))
    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(shorter) - 1), pair))


def in_box(x: Column, y: Column, zone: Column) -> Column:
    """Whether a point lies in an axis-aligned zone; its border belongs to it."""
    return x.between(zone["x0"], zone["x1"]) & y.between(zone["y0"], zone["y1"])


def edges(ring: Column) -> Column:
    """The edges of a closed ring, each as a and b."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))


def _turn(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _on(a: Column, b: Column, p: Column) -> Column:
    inside = p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    return (_turn(a, b, p) == 0) & inside


def in_ring(p: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring: a ray to the right crosses it an odd number of times, or the point is on the border."""
    return in_edges(p, edges(ring))


def in_edges(p: Column, edges: Column) -> Column:
    """As in_ring, from the ring's edges."""
    crosses = lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (
        p["x"] < (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    )
    odd = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return odd | F.exists(edges, lambda e: _on(e["a"], e["b"], p))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    proper = (((t1 > 0) & (t2 < 0)) | ((t1 < 0) & (t2 > 0))) & (((t3 > 0) & (t4 < 0)) | ((t3 < 0) & (t4 > 0)))
    return proper | _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b)


def segment_meets_ring(a: Column, b: Column, ring: Column) -> Column:
    return in_ring(a, ring) | in_ring(b, ring) | F.exists(edges(ring), lambda e: segments_cross(a, b, e["a"], e["b"]))


# The ellipsoid GRS80 and the parameters of EPSG:5186.
A, FLAT = 6378137.0, 1 / 298.257222101
LAT0, LON0, SCALE, EAST0, NORTH0 = math.radians(38.0), math.radians(127.0), 1.0, 200000.0, 600000.0


def _arc(lat: float) -> float:
    e = FLAT * (2 - FLAT)
    return A * ((1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256) * lat - (3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024) * math.sin(2 * lat) + (15 * e**2 / 256 + 45 * e**3 / 1024) * math.sin(4 * lat) - 35 * e**3 / 3072 * math.sin(6 * lat))


def to_wgs84(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude, in degrees, of projected metres: the inverse transverse Mercator series."""
    e = FLAT * (2 - FLAT)
    ep = e / (1 - e)
    e1 = (1 - math.sqrt(1 - e)) / (1 + math.sqrt(1 - e))
    mu = ((north - NORTH0) / SCALE + _arc(LAT0)) / (A * (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    sin2 = F.pow(F.sin(foot), 2.0)
    c, t = ep * F.pow(F.cos(foot), 2.0), F.pow(F.tan(foot), 2.0)
    n = A / F.sqrt(1 - e * sin2)
    r = A * (1 - e) / F.pow(1 - e * sin2, 1.5)
    d = (east - EAST0) / (n * SCALE)
    lat = foot - n * F.tan(foot) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * F.pow(d, 4.0) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * F.pow(d, 6.0) / 720)
    lon = LON0 + (d - (1 + 2 * t + c) * F.pow(d, 3.0) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * F.pow(d, 5.0) / 120) / F.cos(foot)
    return F.degrees(lon), F.degrees(lat)
