"""Periodic runs, repair of conversations, and packing, against plain versions."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import packing, periodic, queries, repair

SF = "/root/testdata/sf0.001"


# Periodic runs


def plain_runs(words, shortest=12):
    """Every stretch with its smallest period, by comparing words: {(start, end): period}."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        for s in range(len(words) - p):
            if s and words[s - 1] == words[s + p - 1]:
                continue
            e = s + p
            while e < len(words) and words[e] == words[e - p]:
                e += 1
            if e - s >= max(shortest, 2 * p):
                best.setdefault((s, e), p)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def ordered(runs):
    return sorted((s, k, p) for s, k, p in runs.tolist())


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_a_plain_walk(letters):
    chance = np.random.default_rng(letters)
    for n in range(0, 90):
        words = chance.integers(0, letters, n)
        if n > 8:
            a = int(chance.integers(0, n))
            p = int(chance.integers(1, max(2, (n - a) // 2)))
            words[a:] = words[a + np.arange(n - a) % p]
        assert ordered(periodic.find_runs(words)) == plain_runs(words.tolist()), words
        assert ordered(periodic.runs_by_walk(words)) == plain_runs(words.tolist())


def test_hashes_that_collide_do_not_mislead():
    words = np.array([bin(i).count("1") & 1 for i in range(3000)])
    assert ordered(periodic.find_runs(words)) == ordered(periodic.runs_by_walk(words))


def test_one_word_again_and_again_is_one_run():
    assert periodic.find_runs(np.zeros(30_000, np.int64)).tolist() == [[0, 30_000, 1]]


def test_the_query_equals_a_plain_version(spark):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, original = g % n, list(words)
            p = 1 + (n - a) // (3 + g % 8)
            words = [original[i] if i < a else original[a + (i - a) % p] for i in range(n)]
        # A text of many words is walked with numbers for words: the walk above would take minutes.
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = plain_runs(words) if n < 400 else periodic.runs_by_walk(np.array([number[w] for w in words])).tolist()
        runs = sorted(map(tuple, runs), key=lambda r: (r[0], r[2]))
        dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        got = rows[d.doc_id]
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *top)
        assert got.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in rows.values()) >= 10


def test_runs_of_odd_rows(spark):
    long = "a b c " * 5000
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "x " * 12, 0), (4, "x " * 12, 0), (5, "x " * 11, 0), (None, long, 0), (6, "ä b " * 6 + "ä c", 0)]
    found = periodic.run_documents(spark.createDataFrame(rows, "doc_id int, text string, runs int")).collect()
    told = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert told[:3] == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], "")]
    assert told[3] == told[4] == (4, 12, [(0, 12, 1)], "x")
    assert told[5] == (5, 11, [], " ".join("x" * 11))
    assert told[6] == (None, 15_000, [(0, 15_000, 3)], "a b c")
    assert told[7][1:3] == (7, [])
    assert periodic.run_documents(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    assert periodic.planted(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().text == "a b"


# Repair


FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_repair(turns):
    """The cheapest edits by trying all of them, the last turns first."""
    rows = [turns[i : i + 2] for i in range(0, len(turns), 2)]

    @lru_cache(None)
    def go(i, last, inserts):
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        add = lambda cost, edit, rest: ways.append((rest[0] + cost, edit + rest[1])) if rest else None
        if inserts < 2:
            for t in FOLLOW[last].replace("s", ""):
                add(5, "I", go(i, t, inserts + 1))
        if i < len(rows):
            initial, fault = rows[i]
            add(2, "D", go(i + 1, last, 0))
            for t in FOLLOW[last] if fault not in "bd" else "":
                extra = 5 * (fault == "t")
                if t == initial:
                    add(extra, "K", go(i + 1, t, 0))
                elif t != "s":
                    add(1 + extra, "R", go(i + 1, t, 0))
        return min(ways, default=None)

    return go(0, "", 0)


def test_repairs_equal_trying_all_edits():
    chance = np.random.default_rng(7)
    for k in range(2500):
        turns = "".join(str(chance.choice(list("suaax"))) + str(chance.choice(list("-----bdt"))) for _ in range(k % 13))
        cost, audit, made = repair.parse(turns)
        assert (cost, audit) == plain_repair(turns), turns
        every = repair.Chart(lead=None)
        for i in range(0, len(turns), 2):
            every.read(turns[i], turns[i + 1])
        assert every.best() == (cost, audit, made)
        assert re.fullmatch("(s?(ua)+)?", made) and len(made) == sum(c in "KRI" for c in audit)


def test_what_is_put_aside_changes_nothing(monkeypatch):
    chance = np.random.default_rng(8)
    turns = "".join(str(chance.choice(list("suaax"))) + str(chance.choice(list("-----bdt"))) for _ in range(700))
    told = repair.parse(turns)
    monkeypatch.setattr(repair, "SETTLE", 1 << 30)
    assert repair.parse(turns) == told
    chart = repair.Chart()
    monkeypatch.setattr(repair, "SETTLE", 64)
    for i in range(0, 1400, 2):
        chart.read(turns[i], turns[i + 1])
        if i % 128 == 126:
            chart.settle()
    assert len(chart.sets) <= 2 and max(len(w[1]) for w in chart.items.values()) < 200


def test_faults_of_turns():
    assert [repair.fault_of(t, again) for t, again in [(" \t", True), ("", False), ("So.", True), ("So", False), ("So! \n", False), (" ", False)]] == ["b", "b", "d", "t", "-", "t"]


def test_repair_of_odd_rows(spark):
    rows = [(1, 0, "user", "Hi.", False), (1, 1, "assistant", "Yes.", False), (2, None, None, None, False), (3, 0, "user", "x.", True), (None, 0, "user", "Hi.", False), (None, 4, "user", "No.", False), (4, 1, "", "Hi.", False), (4, 1, "assistant", "Ah.", False), (5, 2, "user", "A.", False), (5, 2, "user", "A.", False), (5, 5, "assistant", "B.", False)]
    found = {r.conv_id: r for r in repair.repair_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, gone boolean").withColumn("cost", F.lit("clash"))).collect()}
    told = {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for k, r in found.items()}
    assert told == {1: (0, 0, 0, 0, 0, 0, "KK"), 2: (0, 1, 0, 0, 0, 2, "D"), 3: (0, 0, 0, 0, 0, 0, ""), None: (3, 0, 0, 0, 1, 1, "KR"), 4: (0, 0, 0, 0, 1, 1, "RK"), 5: (2, 0, 1, 0, 1, 2, "KDK")}
    assert [tuple(t) for t in found[4].repaired] == [("user", "Hi."), ("assistant", "Ah.")]
    assert found[3].repaired == []
    assert repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# Packing


def test_places_are_gapless_and_few(spark):
    chance = np.random.default_rng(3)
    lengths = np.minimum(chance.lognormal(6.3, 1.0, 6000).astype(int) + 1, 2048)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(pieces).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    check_places(rows)
    assert len({r.sequence_id for r in rows}) <= 1.01 * -(-lengths.sum() // 2048)


def check_places(rows):
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= 2048


def test_a_piece_goes_where_the_sum_of_squares_becomes_smallest():
    chance = np.random.default_rng(5)
    packer, gaps = packing.Packer(50), {}
    for n in chance.integers(1, 51, 400).tolist():
        fits = {g for g in gaps.values() if g >= n}

        def squares(g):
            after = sorted([*gaps.values()])
            after.remove(g)
            after += [g - n] * (g > n)
            return sum(after.count(x) ** 2 for x in set(after) if x)

        want = min(fits, key=lambda g: (squares(g), g), default=None)
        at, offset = packer.place(n)
        assert offset == (50 - want if want else 0)
        gaps[at] = 50 - offset - n
        if not gaps[at]:
            del gaps[at]


def test_packed_documents_hold_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, ""), (-2, "Aa bb. " * 3000), (-2, "Aa bb. " * 3000)], "doc_id long, text string"))
    rows = packing.pack_documents(docs, path, ids=True).collect()
    check_places(rows)
    want = sorted(((d.doc_id, p, at, len(part), zlib.crc32(part.tobytes()), part.tobytes()) for d in docs.collect() for ids in [np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")] for p, at in enumerate(range(0, len(ids), 2048)) for part in [ids[at : at + 2048]]), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows), key=str) == want
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1 + 1.02 * total / 2048


def test_packing_of_an_empty_table_and_of_clashing_names(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path()).collect() == []
    rows = packing.pack(spark.createDataFrame([(1, 2048, 9), (1, 2048, 9), (2, 1, 9), (2, 1, 9)], "doc_id int, length long, offset int")).collect()
    assert sorted((r.length, r.offset) for r in rows) == [(1, 0), (1, 1), (2048, 0), (2048, 0)]
