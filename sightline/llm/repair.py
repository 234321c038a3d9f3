"""Repair of the order of turns in conversations: error-correcting Earley parsing of roles."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Initials of the roles of a conversation: a system turn or none, then user and assistant in turn; or nothing at all. Recursion on the left keeps the
#: items of a chart few.
GRAMMAR = (("S", ()), ("S", ("B",)), ("B", ("s", "u", "a")), ("B", ("u", "a")), ("B", ("B", "u", "a")))
#: Roles that a turn can be given, by their initials.
MADE = {"u": "user", "a": "assistant"}
#: Characters that end a text that is whole.
ENDS = ".!?"
BLANK = " \t\n\x0b\x0c\r"
#: After so many turns what all items agree on is put aside. Conversations up to so many turns are looked up among those parsed before.
SETTLE, SHORT = 64, 16


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    @property
    def lead(self) -> int:
        """By how much an item of GRAMMAR may cost more than another and still win: the other can insert the two turns at most that part them, and
        delete a system turn that the first would keep."""
        return 2 * self.insert + self.delete


class Chart:
    """An Earley chart over turns. An item is a rule, how much of it has been met, and the set where it began; it retains the least cost and audit of
    the ways to it, and the terminals that these make. Audits name the edits in order: Keep, Rerole, Delete, Insert.

    The scanner takes a turn by the production of its terminal (Keep), of another one that may be made (Rerole), or of none (Delete); a terminal
    that may be made also derives from nothing (Insert). Two ways to one item that cost the same are of the same turns, so neither audit begins the
    other, and the least audit stays the least whatever follows. Only sets that items still refer to are kept, and no items that are more than `lead`
    dearer than the cheapest one, which holds for GRAMMAR; None keeps all.
    """

    def __init__(self, grammar=GRAMMAR, made: Iterable[str] = tuple(MADE), costs: Costs = Costs(), lead: int | None = Costs().lead):
        self.lead = lead
        self.rules, self.made, self.costs, self.start = grammar, frozenset(made), costs, grammar[0][0]
        self.heads = {head for head, _ in grammar}
        self.at, self.done, self.sets = 0, ("", ""), {}
        self.items = {(k, 0, 0): (0, "", "") for k, (head, _) in enumerate(grammar) if head == self.start}
        self.close()

    def next(self, item) -> str | None:
        body = self.rules[item[0]][1]
        return body[item[1]] if item[1] < len(body) else None

    @staticmethod
    def keep(items: dict, item, way) -> bool:
        """Retain a way to an item if it is better than the one known."""
        if item not in items or way[:2] < items[item][:2]:
            items[item] = way
            return True
        return False

    def close(self) -> None:
        """Predict, complete and insert until nothing changes."""
        items, self.sets[self.at] = self.items, self.items
        todo = list(items)
        while todo:
            item = todo.pop()
            way, symbol, (rule, dot, began) = items[item], self.next(item), item
            if symbol is None:
                head = self.rules[rule][0]
                new = [((r, d + 1, b), tuple(x + y for x, y in zip(w, way))) for (r, d, b), w in list(self.sets[began].items()) if self.next((r, d, b)) == head]
            elif symbol in self.heads:
                new = [((k, 0, self.at), (0, "", "")) for k, (head, _) in enumerate(self.rules) if head == symbol]
                new += [((rule, dot + 1, began), tuple(x + y for x, y in zip(way, w))) for (r, d, b), w in list(items.items()) if b == self.at and self.rules[r][0] == symbol and d == len(self.rules[r][1])]
            else:
                new = [((rule, dot + 1, began), (way[0] + self.costs.insert, way[1] + "I", way[2] + symbol))] if symbol in self.made else []
            todo += [i for i, w in new if self.keep(items, i, w)]

    def read(self, initial: str, fault: str) -> None:
        """The next turn: the initial of its role (blank if it has none), and its fault: b and d must be deleted, t is truncated."""
        items, c = {}, self.costs
        extra = c.truncated if fault == "t" else 0
        for item, (cost, audit, out) in self.items.items():
            symbol, (rule, dot, began) = self.next(item), item
            whole = symbol is None and self.rules[rule][0] == self.start and began == 0
            if whole or symbol is not None and symbol not in self.heads:
                self.keep(items, item, (cost + c.delete, audit + "D", out))
                if whole or fault in ("b", "d"):
                    continue
                if symbol == initial:
                    self.keep(items, (rule, dot + 1, began), (cost + extra, audit + "K", out + symbol))
                elif symbol in self.made:
                    self.keep(items, (rule, dot + 1, began), (cost + extra + c.rerole, audit + "R", out + symbol))
        self.items, self.at = items, self.at + 1
        live = {began for _, _, began in items}
        self.sets = {k: s for k, s in self.sets.items() if k in live}
        self.close()
        if self.lead is not None:
            dearest = min(w[0] for w in self.items.values()) + self.lead
            self.items = self.sets[self.at] = {i: w for i, w in self.items.items() if w[0] <= dearest}

    def settle(self) -> None:
        """Put aside what all items agree on. Only where every item began at the start: then its way is the whole way."""
        if all(began == 0 for _, _, began in self.items) and set(self.sets) <= {0, self.at}:
            audit, out = (os.path.commonprefix([w[k] for w in self.items.values()]) for k in (1, 2))
            kept = sum(c in "KRI" for c in audit)
            # Terminals and edits must part at one place.
            if kept <= len(out):
                self.done = self.done[0] + audit, self.done[1] + out[:kept]
                for item, (cost, a, o) in self.items.items():
                    self.items[item] = (cost, a[len(audit) :], o[kept:])
                self.sets[self.at] = self.items

    def best(self) -> tuple[int, str, str]:
        """Cost, audit and terminals of the cheapest repair of all turns so far."""
        cost, audit, out = min(w for (rule, dot, began), w in self.items.items() if self.rules[rule][0] == self.start and dot == len(self.rules[rule][1]) and began == 0)
        return cost, self.done[0] + audit, self.done[1] + out


def parse(turns: str) -> tuple[int, str, str]:
    """The cheapest repair of turns, each two characters: initial and fault."""
    chart = Chart()
    for i in range(0, len(turns), 2):
        chart.read(turns[i], turns[i + 1])
        if i // 2 % SETTLE == SETTLE - 1:
            chart.settle()
    return chart.best()


_short = functools.lru_cache(1 << 16)(parse)


def fault_of(text: str, again: bool) -> str:
    """The first fault of a turn: blank, duplicate (`again`), truncated, or none."""
    bare = text.rstrip(BLANK)
    return "b" if not bare else "d" if again else "t" if bare[-1] not in ENDS else "-"


def repaired(rows: list[tuple]) -> dict:
    """What `repair_conversations` tells of one conversation. rows: turn, role, text, again; in order."""
    faults = [fault_of(text, again) for _, _, text, again in rows]
    initials = [role[:1] for _, role, _, _ in rows]
    turns = "".join((c or "\0") + f for c, f in zip(initials, faults))
    cost, audit, made = (_short if len(rows) <= SHORT else parse)(turns)
    left, out, sources = iter(made), [], iter(rows)
    for edit in audit:
        row = next(sources) if edit != "I" else (None, "", "", False)
        if edit != "D":
            role = next(left)
            out.append({"role": row[1] if edit == "K" else MADE[role], "text": row[2]})
    stamps = [t for t, *_ in rows if t is not None]
    counts = {name: faults.count(name[0]) for name in ("blank", "duplicate", "truncated")}
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return {"gaps": max(stamps) - min(stamps) + 1 - len(set(stamps)) if stamps else 0, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired": out}


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id; gaps (turn numbers that are missing between its first and last); blank, duplicate and truncated turns
    (of each turn the first fault); illegal (neighbouring roles that no conversation has); cost and audit of the cheapest repair; and `repaired`, its
    turns (role, text).

    rows: conv_id, turn, role, text, and maybe `gone` (true: the row only names its conversation); other columns are ignored. A null conv_id is a
    conversation of its own. Turns go in order, nulls first; ties by role, then text. Null roles and texts are one blank. Repeated rows are turns of
    their own, of which the later ones are duplicates. A role without a first character can only be deleted or changed. An empty table gives no rows, a
    conversation without turns has zeros, an empty audit and no turns.
    Rows are dealt once, by conversation, and sorted there; a task holds one conversation, which is one row of the result, of whatever length.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    place = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn")))
    dealt = named.repartition("conv_id").withColumn("again", place > 1)
    ordered = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    kind = dict(ordered.dtypes)["conv_id"]
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def conversations(batches) -> Iterator[tuple]:
        held, rows, begun = None, [], False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "again")]
            for conv, gone, *row in zip(*columns):
                if begun and conv != held:
                    yield held, rows
                    rows = []
                held, begun = conv, True
                if not gone:
                    rows.append(tuple(row))
        if begun:
            yield held, rows

    def told(batches):
        names, ids, size, id_type = [*counts, "audit", "repaired"], [], 0, None
        found = []

        def flush():
            arrays = [pa.array(ids, id_type), *(pa.array([f[c] for f in found], pa.int64()) for c in counts), pa.array([f["audit"] for f in found], pa.string()), pa.array([f["repaired"] for f in found], turns)]
            batch = pa.RecordBatch.from_arrays(arrays, ["conv_id", *names])
            ids.clear()
            found.clear()
            return batch

        def typed():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield batch

        for conv, rows in conversations(typed()):
            ids.append(conv)
            found.append(repaired(rows))
            size += sum(len(r[2]) for r in rows)
            if len(ids) >= 1000 or size > 4 << 20:
                yield flush()
                size = 0
        if ids:
            yield flush()

    shape = f"conv_id {kind}, {', '.join(f'{c} bigint' for c in counts)}, audit string, repaired array<struct<role: string, text: string>>"
    return ordered.mapInArrow(told, shape)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations of which a fourth of the rows is damaged, by the CRC-32 of `conv_id:turn` modulo 20: 0 drops a row (it stays as `gone`),
    1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it the user's. Nulls count as one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).when(kind != 0, blank("text"))
    role = F.when(kind == 4, "user").when(kind != 0, blank("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("__copy")).drop("__copy")


def lines(turns: Column) -> Column:
    """Turns as text: `role:text`, one after another, parted by line feeds."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
