"""Periodic runs of words: stretches of a text that repeat themselves with a period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import _BACK, _STEP, _powers, fields_of, mix, sliced

#: Words that a run has at least, and how often its period goes into it.
SHORTEST, TIMES = 12, 2
#: Multiples of the period of a run that goes so often into it are not looked at within it again.
LONG = 16
#: Pairs of a period and a grid point that are looked at together.
PAIRS = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def numbered(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in UTF-8, and a number for each that equal words share."""
    words = text.encode().split() if text else []
    number: dict[bytes, int] = {}
    return words, np.array([number.setdefault(w, len(number)) for w in words], np.int64)


def grid(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The harmonic grid: every period up to `longest` with the multiples of it that lie a period before the end, about n ln n pairs, in blocks."""
    low = 1
    while low <= longest:
        high = min(longest, low + max(1, PAIRS * low // n))
        periods = np.arange(low, high + 1)
        points = (n - 1) // periods
        period = np.repeat(periods, points)
        place = np.arange(len(period)) - np.repeat(np.cumsum(points) - points, points)
        yield period, place * period
        low = high + 1


def extensions(total: np.ndarray, powers: np.ndarray, at: np.ndarray, period: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words from `at` on (or before it) equal those a period later, for all pairs at once: a binary search on the prefix hashes, by halving
    steps. `room`: how far there are words at all."""
    got = np.zeros(len(at), np.int64)
    step = 1 << (int(room.max(initial=0)).bit_length() - 1) if len(at) and room.max() > 0 else 0
    while step:
        some = np.flatnonzero(got + step <= room)
        far = got[some] + step
        first = at[some] - far if back else at[some]
        last, p = first + far, period[some]
        same = (total[last] - total[first]) * powers[p] == total[last + p] - total[first + p]
        got[some[same]] += step
        step >>= 1
    return got


def runs_by_walk(number: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """The runs by comparing the words themselves, period by period; quadratic. For texts whose hashes collide."""
    n, best = len(number), {}
    for p in range(1, n // TIMES + 1):
        same = np.concatenate([[False], number[:-p] == number[p:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s + p >= max(shortest, TIMES * p):
                best.setdefault((s, e + p), p)
    return np.array(sorted((s, e - s, p) for (s, e), p in best.items()), np.int64).reshape(-1, 3)


def in_three(padded: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Of pairs whose words agree, those with three places in a row that do: a run of 5 words or more has no fewer. `padded` has two more at each end."""
    two_before, before, after, two_after = (padded[at + k] == padded[at + period + k] for k in (0, 1, 3, 4))
    return np.flatnonzero((before & (two_before | after)) | (after & two_after))


def heads(rows: np.ndarray) -> np.ndarray:
    """Which of sorted rows are the first of their stretch."""
    return np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:, :2] != rows[:-1, :2]).any(1)])


def find_runs(number: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """All runs of a sequence of numbers: rows of start, length and smallest period, by start and period.

    A run of period p holds, within its first p places, a multiple of p whose number comes again p later. So: all pairs of the harmonic grid whose
    numbers agree are extended to both sides at once, what reaches twice the period is a run, and runs of one stretch are one, that of the smallest
    period. Pairs within a long run that is known already, at a multiple of its period, would lead to it again. Every run is verified number by
    number; if a hash has misled one, the sequence is done again without hashes.
    """
    n = len(number)
    longest = n // TIMES
    if n < shortest or longest < 1:
        return np.empty((0, 3), np.int64)
    total, padded = None, np.concatenate([[-1, -1], number, [-2, -2]])
    found, run_of, period_of = [], np.full(n, -1), [1]
    for period, at in grid(n, longest):
        same = number[at] == number[at + period]
        if len(period_of) > 1:
            run = run_of[at]
            same &= (run < 0) | (run != run_of[at + period]) | (period % np.array(period_of)[run] != 0)
        same = np.flatnonzero(same)
        period, at = period[same], at[same]
        if shortest >= 5:
            some = in_three(padded, at, period)
            period, at = period[some], at[some]
        if not len(at):
            continue
        if total is None:
            powers, total = _powers(_STEP, n + 1), np.zeros(n + 1, np.uint64)
            np.cumsum(mix((number.astype(np.uint64) + np.uint64(1)) * _BACK) * powers[:n], out=total[1:])
        after = extensions(total, powers, at, period, n - at - period, False)
        before = extensions(total, powers, at, period, at, True)
        length = before + after + period
        kept = length >= np.maximum(shortest, TIMES * period)
        now = np.unique(np.stack([at - before, length, period], 1)[kept], axis=0)
        found.append(now)
        for s, k, p in now[heads(now)].tolist():
            if k < LONG * p:
                continue
            run_of[s : s + k] = len(period_of)
            period_of.append(p)
    rows = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
    if not len(rows):
        return rows
    head = heads(rows)
    least = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0)), 2]
    true = not (rows[:, 2] % least).any() and all((number[s : s + length - p] == number[s + p : s + length]).all() for s, length, p in rows[head].tolist())
    if not true:
        return runs_by_walk(number, shortest)
    kept = rows[head]
    return kept[np.lexsort((kept[:, 2], kept[:, 0]))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words some run holds beyond its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def run_documents(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The runs of every whole text: all columns, then `n_words`, `runs` (start, length, period; by start, then period) and `collapsed`, the words
    that no run repeats, joined by one blank.

    A run is a stretch of at least `shortest` words and two periods that keeps its smallest period and can't be longer. Null and empty texts, and
    texts of fewer words, have no runs; null has the empty text collapsed. Runs of equal length or start are all given. Repeated rows get equal
    results. A text of any length is one row: what a task holds is some arrays of its words and PAIRS pairs. An empty table gives no rows. Input
    columns of the new names are replaced.
    """
    added = ["n_words", "runs", "collapsed"]
    keep = [c for c in docs.columns if c not in added]
    chosen = docs.select(*keep)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def told(batches):
        for batch in sliced(batches):
            counts, all_runs, left = [], [], []
            for text in batch.column("text").to_pylist():
                words, number = numbered(text)
                runs = find_runs(number, shortest)
                if len(runs):
                    words = [w for w, drop in zip(words, repeated(runs, len(words)).tolist()) if not drop]
                counts.append(len(number))
                all_runs.append([{"start": s, "length": k, "period": p} for s, k, p in runs.tolist()])
                left.append(b" ".join(words).decode())
            columns = [pa.array(counts, pa.int64()), pa.array(all_runs, kind), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*keep, *added])

    return chosen.mapInArrow(told, f"{fields_of(chosen.schema)}, n_words bigint, runs {RUNS}, collapsed string")


def words_of(text: Column) -> Column:
    """The words of a text as an array, without null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the CRC-32 of the id, ends in a repeated stretch: doc_id and text.

    With h of the id, g = h // 10 and n words: if h % 10 = 0, each word i from a = g % n on is the word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    A null id has no decimal form, so its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("__w").cast("long")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("__w"), g.alias("__g"))
    placed = chosen.withColumn("__a", F.when(n > 0, F.col("__g") % n)).withColumn("__p", 1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8)))
    word = lambda i: F.get("__w", F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return placed.select("doc_id", F.when(F.col("__a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def longest_run(runs: Column) -> Column:
    """The longest run of an array: of equal ones that which starts first, then that of the smallest period. Null if there is none."""
    return F.get(F.array_sort(runs, lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")), 0)


def runs_text(runs: Column) -> Column:
    """Every run as `start,length,period` and a line feed."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
