"""Chat formatting: from reply trees to conversations in a chat template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import materialize

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Break up whatever could be read as a control string; undone by unescape."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """A role also ends at its line's end, so a line feed is written as a backslash and n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes part the text; between them a backslash belongs to what follows it."""
    part = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), part), "\\")


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Self-joins that double their reach: jumps[k] leads from a node to the one 2**k above it.

    nodes: tree, node, parent, score. Also returns, for each node under a root, its depth and the score summed from the root.
    A node is under a root if its chain of parents ends at a null; nodes on or below a cycle, or below a missing parent, are not.
    """
    known = nodes.select(F.col("tree").alias("__tree"), F.col("node").alias("__known")).distinct()
    linked = nodes.join(known, (F.col("__tree") == F.col("tree")) & (F.col("__known") == F.col("parent")), "left")
    orphan = F.col("parent").isNotNull() & F.col("__known").isNull()
    # An orphan points at itself and so never reaches a root.
    jump = materialize(linked.select("tree", "node", F.when(orphan, F.col("node")).otherwise(F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.lit(1).cast("long").alias("steps")))
    limit, jumps, columns = jump.count(), [], ("tree", "node", "up", "score", "steps")
    # Only nodes that have not met their root yet are joined again.
    placed, reach = jump.where("up is null"), jump.where("up is not null")
    while (1 << len(jumps)) <= limit and not reach.isEmpty():
        jumps.append(reach.select("tree", "node", "up"))
        above = placed.union(reach).select(*(F.col(c).alias(f"__{c}") for c in columns))
        joined = reach.join(above, (F.col("tree") == F.col("__tree")) & (F.col("up") == F.col("__node")))
        jump = materialize(joined.select("tree", "node", F.col("__up").alias("up"), (F.col("score") + F.col("__score")).alias("score"), (F.col("steps") + F.col("__steps")).alias("steps")))
        placed, reach = placed.union(jump.where("up is null")), jump.where("up is not null")
    return jumps, placed.select("tree", "node", (F.col("steps") - 1).alias("depth"), "score")


def chosen_leaves(nodes: DataFrame, placed: DataFrame, top: int) -> DataFrame:
    """The leaves of the `top` best branches of each tree; ties go to the smaller leaf. Ranked in salted parts first."""
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node"))
    leaves = placed.join(parents, ["tree", "node"], "left_anti").withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    order = [F.desc("score"), F.asc("node")]
    part = leaves.withColumn("__rank", F.row_number().over(Window.partitionBy("tree", "__salt").orderBy(*order))).where(F.col("__rank") <= top)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(*order))
    return part.withColumn("branch", rank).where(F.col("branch") <= top).select("tree", F.col("node").alias("leaf"), "branch", F.col("score").alias("branch_score"))


def format_trees(messages: DataFrame, top: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format the `top` best root-to-leaf paths of each reply tree, one conversation each.

    messages: tree, node, parent (null: root), role, text, score (null: 0); other columns are ignored. (tree, node) is a key;
    of repeated keys each row is a message of its own at the same place. A branch's score is the sum of its nodes' scores.
    Columns: tree, leaf, branch (1: best), branch_score, n_turns, formatted, loss_spans (array of start and end in code points:
    the escaped texts of the roles in `learn`).
    Null role or text: empty. An empty table gives no rows. Trees without a root (cycles, missing parents) give none either.
    Texts are joined once, after the paths are known; what is held for a path is one row of the result.
    """
    nodes = materialize(messages.select("tree", "node", "parent", F.col("score").cast("double").alias("score")).where("tree is not null and node is not null"))
    jumps, placed = ancestors(nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score")))
    leaves = materialize(chosen_leaves(nodes, placed, top))
    on_path = leaves.select("tree", "leaf", "branch", "branch_score", F.col("leaf").alias("node"))
    for jump in reversed(jumps):
        both = on_path.join(jump, ["tree", "node"], "left").withColumn("node", F.explode(F.array("node", "up")))
        on_path = materialize(both.where("node is not null").drop("up"))
    turns = on_path.join(placed.select("tree", "node", "depth"), ["tree", "node"]).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(BEGIN), escape_role(role), F.lit("\n"))
    turns = turns.select("tree", "leaf", "branch", "branch_score", "depth", role.alias("role"), head.alias("head"), text.alias("body"))
    order = Window.partitionBy("tree", "leaf").orderBy("depth", "role", "body")
    length = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("at", F.row_number().over(order)).withColumn("begin", F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    pieces = F.array_sort(F.collect_list(F.struct("at", "role", F.concat("head", "body", F.lit(END)).alias("piece"), "begin", (F.col("begin") + F.length("body")).alias("end"))))
    told = turns.groupBy("tree", "leaf", "branch", "branch_score").agg(pieces.alias("__t"))
    spans = F.transform(F.filter("__t", lambda t: t["role"].isin(*learn)), lambda t: F.struct(t["begin"].alias("start"), t["end"].alias("end")))
    return told.select("tree", "leaf", "branch", "branch_score", F.size("__t").cast("long").alias("n_turns"), F.array_join(F.transform("__t", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Read the turns back: an array of role and text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda x: x != "")
    bodies = F.transform(parts, lambda x: F.substring(x, F.lit(len(BEGIN) + 1), F.length(x)))
    return F.transform(bodies, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it.

    Rows go by turn (nulls last), ties by role and text. Rows without a conv_id form one conversation with a null conv_id. A conversation of any
    length, and texts of any length, are one row of the formatted result, and no more of them is held than that. Repeated rows are turns of their
    own. An empty table gives no rows; other columns are not read. Rows are ordered once, and written, so that ids are read without texts later.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    at = F.row_number().over(order).cast("long")
    placed = conversations.select("conv_id", "role", "text", at.alias("node")).select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none")).alias("tree"),
        "conv_id",
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )
    return materialize(placed)
