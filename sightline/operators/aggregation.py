"""Aggregators that a user writes: partial states of rows, merged, and closed to a result."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.tables import materialize

#: Partial states of one key are merged in this many places before they meet, and about so many states are merged at once.
SALTS, STATES = 32, 50_000


class Aggregator(Protocol):
    """STATE and OUT are schemas of a partial state and of a result. All take frames of many keys: partial and merge give one row for each value of `by`
    (nulls are a value), close replaces STATE by OUT. merge must not depend on the order of states."""

    STATE: str
    OUT: str

    def partial(self, rows: pd.DataFrame, by: list[str]) -> pd.DataFrame: ...

    def merge(self, states: pd.DataFrame, by: list[str]) -> pd.DataFrame: ...

    def close(self, states: pd.DataFrame) -> pd.DataFrame: ...


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def aggregated(df: DataFrame, by: list[str], aggregator: Aggregator, salts: int = SALTS, at_once: int = STATES) -> DataFrame:
    """A row for each key: by, then the aggregator's OUT. Rows with null keys are a group; no rows, no groups.

    Rows are folded to partial states where they lie, one for each key and Arrow batch; only states are shuffled. They are counted and dealt by their keys
    into parts of about `at_once`, at first with a salt, so that a key with very many states is no single task's.
    """
    keys = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    state, out = names(aggregator.STATE), names(aggregator.OUT)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield aggregator.partial(frame, by)[[*by, *state]]

    def merge(states):
        return aggregator.merge(states[[*by, *state]], by)[[*by, *state]]

    def close(states):
        return aggregator.close(aggregator.merge(states[[*by, *state]], by))[[*by, *out]]

    folded = materialize(df.mapInPandas(fold, f"{keys}, {aggregator.STATE}").withColumn("__salt", F.spark_partition_id() % salts))
    parts = 1 + folded.count() // at_once
    part = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(parts)).alias("__part")
    merged = folded.groupBy(part(*by, "__salt")).applyInPandas(merge, f"{keys}, {aggregator.STATE}")
    return merged.groupBy(part(*by)).applyInPandas(close, f"{keys}, {aggregator.OUT}")


def rounded(values: pd.Series, digits: int = 4) -> pd.Series:
    """As SQL's round: a half goes away from zero, where pandas takes it to the even digit."""
    scaled = values * 10.0**digits
    whole = np.trunc(scaled)
    near = (whole + np.sign(scaled) * ((scaled - whole).abs() >= 0.5)) / 10.0**digits
    return near.where(np.isfinite(near), values)


def _sum(values: list[float]) -> tuple[float, float]:
    """The sum as the nearest double, and what that leaves out."""
    try:
        total = math.fsum(values)
        return total, math.fsum([*values, -total])
    except (OverflowError, ValueError):  # beyond doubles, or infinite
        return sum(values), 0.0


class Spread:
    """Number of rows, mean place and root mean square distance from it. A missing coordinate counts for neither, as in SQL.

    Sums are two doubles, so means don't depend on how rows are dealt. Squares are about the mean, so far-off places lose no digits.
    """

    STATE = "n long, n_x long, x double, x_rest double, x_squares double, n_y long, y double, y_rest double, y_squares double"
    OUT = "n long, x double, y double, spread double"

    def partial(self, rows, by):
        states = rows[by].assign(n=1)
        for c in "xy":
            states = states.assign(**{f"n_{c}": rows[c].notna().astype("int64"), c: rows[c].fillna(0.0), f"{c}_rest": 0.0, f"{c}_squares": 0.0})
        return self.merge(states, by)

    def merge(self, states, by):
        group = states.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        states, starts = states.iloc[order], np.flatnonzero(np.diff(group[order], prepend=-1))
        many = np.diff(starts, append=len(states))
        told = states[by].iloc[starts].reset_index(drop=True).assign(n=np.add.reduceat(states.n.to_numpy(), starts))
        for c in "xy":
            n, parts = states[f"n_{c}"].to_numpy(), states[[c, f"{c}_rest"]].to_numpy(dtype="float64")
            flat = parts.ravel().tolist()
            total, rest = np.array([_sum(flat[2 * a : 2 * b]) for a, b in zip(starts.tolist(), (starts + many).tolist())]).T
            all_n = np.add.reduceat(n, starts)
            mean = np.repeat((total + rest) / np.maximum(all_n, 1), many)
            off = np.where(n > 0, n * (parts.sum(axis=1) / np.maximum(n, 1) - mean) ** 2, 0.0)
            squares = np.add.reduceat(states[f"{c}_squares"].to_numpy() + off, starts)
            told = told.assign(**{f"n_{c}": all_n, c: total, f"{c}_rest": rest, f"{c}_squares": squares})
        return told

    def close(self, states):
        mean = lambda c: rounded((states[c] + states[f"{c}_rest"]) / states[f"n_{c}"])
        return states.assign(x=mean("x"), y=mean("y"), spread=rounded((states.x_squares / states.n_x + states.y_squares / states.n_y) ** 0.5))


class Extent:
    """Box around the places, and the time and x of the last one (ties: the greatest x)."""

    STATE = "left double, right double, low double, high double, ts long, last_x double"
    OUT = "width double, height double, ts long, last_x double"

    def partial(self, rows, by):
        return self.merge(rows.assign(left=rows.x, right=rows.x, low=rows.y, high=rows.y, last_x=rows.x), by)

    def merge(self, states, by):
        groups = states.sort_values(["ts", "last_x"]).groupby(by, dropna=False, sort=False)
        ends = {"left": "min", "right": "max", "low": "min", "high": "max", "ts": "last", "last_x": "last"}
        return groups.agg(ends).reset_index()

    def close(self, states):
        return states.assign(width=(states.right - states.left).round(4), height=(states.high - states.low).round(4))
