"""Configuration and dimension tables from YAML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_METRES = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0}


class ConfigurationError(ValueError):
    """A setting that is missing or can't be read."""


def _measure(text: str | int | float, units: dict, plain: str):
    m = re.fullmatch(r"\s*([0-9.]+)\s*([a-z]*)\s*", str(text))
    if not m or (m[2] and m[2] not in units):
        raise ConfigurationError(f"not a measure in {', '.join(units)}: {text!r}")
    return float(m[1]) * units[m[2] or plain]


def duration(text: str | int) -> int:
    """Milliseconds of `1s`, `500ms`, `3m`, ...; numbers without a unit are milliseconds."""
    return int(_measure(text, _MS, "ms"))


def length(text: str | float) -> float:
    """Metres of `8m`, `50cm`, ...; numbers without a unit are metres."""
    return _measure(text, _METRES, "m")


@dataclass(frozen=True)
class Motion:
    window: int = 1000
    advance: int = 1000
    grace: int = 0
    most: float = 5.0


@dataclass(frozen=True)
class Feature:
    listening: tuple[str, ...] = ()
    delay: int = 0
    least_score: float = 0.3
    share: float = 0.2


@dataclass(frozen=True)
class Output:
    most_delay: int = 180_000
    interval: int = 100
    grace: int = 100


@dataclass(frozen=True)
class Config:
    """Settings; every one has a default. Connection strings are not among them: take those from the environment."""

    motion: Motion = field(default_factory=Motion)
    feature: Feature = field(default_factory=Feature)
    output: Output = field(default_factory=Output)


def load(text: str) -> Config:
    """Read the sections motion, feature and output of a YAML document."""
    import yaml

    spec = yaml.safe_load(text) or {}
    m, f, o = (spec.get(k) or {} for k in ("motion", "feature", "output"))
    window = duration(m.get("window-size", 1000))
    return Config(
        Motion(window, duration(m.get("window-advance", window)), duration(m.get("window-grace", 0)), length(m.get("max-distance", 5))),
        Feature(tuple(f.get("listening-nodes") or ()), duration(f.get("match-delay", 0)), float(f.get("min-score", 0.3)), float(f.get("top-percent", 0.2))),
        Output(duration(o.get("max-association-delay", "3m")), duration(o.get("interval", 100)), duration(o.get("grace", 100))),
    )


def areas(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """area_nodes and area_pairs of a YAML document: for each area, `bindings` (pairs of nodes) and `distance_threshold` by node."""
    import yaml

    nodes, pairs, seen = [], [], {}
    for area, spec in (yaml.safe_load(text) or {}).items():
        limits = {k: length(v) for k, v in (spec.get("distance_threshold") or {}).items()}
        bound = [tuple(sorted(p)) for p in spec.get("bindings") or []]
        for node in sorted({n for p in bound for n in p} | set(limits)):
            if seen.setdefault(node, area) != area:
                raise ConfigurationError(f"node {node} is in the areas {seen[node]} and {area}")
            nodes.append((area, node, limits.get(node)))
        pairs += [(area, *p) for p in bound]
    return spark.createDataFrame(nodes, "area string, node string, threshold double"), spark.createDataFrame(pairs, "area string, node1 string, node2 string")


def zones(spark: SparkSession, text: str) -> DataFrame:
    """Zones of a YAML document: id to a list of [x, y]; open rings are closed."""
    import yaml

    rows = []
    for zone, points in (yaml.safe_load(text) or {}).items():
        ring = [(float(x), float(y)) for x, y in points]
        rows.append((str(zone), ring if ring[0] == ring[-1] else [*ring, ring[0]]))
    if not rows:
        raise ConfigurationError("no zones")
    return spark.createDataFrame(rows, "zone string, ring array<struct<x: double, y: double>>")


def links(spark: SparkSession, text: str) -> DataFrame:
    """Links of a camera network: node, enter zone, and what it is reached from in which time."""
    import yaml

    rows = []
    for node, entries in (yaml.safe_load(text) or {}).items():
        for zone, sources in entries.items():
            for s in sources:
                (exit_node, exit_zone), (low, high) = s["coming_from"], s["transition_time"]
                rows.append((node, str(zone), exit_node, str(exit_zone), duration(low), duration(high)))
    return spark.createDataFrame(rows, "enter_node string, enter_zone string, exit_node string, exit_zone string, min_ms bigint, max_ms bigint")
