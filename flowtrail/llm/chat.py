"""Chat formatting over reply trees (DataFrame functions only).

Nodes of a reply tree point to their parents. Root-to-leaf paths are enumerated by iterative
self-joins in which every step doubles the distance covered, so a path of n nodes takes log2(n)
steps. The paths of a tree are ranked by the sum of their nodes' scores, and each chosen path becomes
one conversation: turns between markers, with control strings inside texts escaped reversibly, and
the spans of the assistant's texts as the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that chat templates give a meaning. Each starts with < or [ and has neither further on, so
#: no control string can come about where a text and a marker meet.
CONTROL = (r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", r"/?s>", r"/?INST\]")
_ANY = "|".join(CONTROL)
#: Turns that are put together first, so that a very long conversation is not one task's list of rows.
CHUNK = 256
#: Parts of a tree in which leaves are ranked before the best of all are.
PARTS = 64


def escape(text: Column) -> Column:
    """A backslash after the first character of each control string, and one more where there are some."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_ANY})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_ANY})", "$1$2$3")


def chains(turns: DataFrame) -> DataFrame:
    """Nodes of reply trees from flat conversations (conv_id, turn, role, text): each turn answers the one before.

    Rows follow by turn (null first), then role and text, null counting as empty; equal rows are
    interchangeable. Positions are counted within 64 turns and summed over those, so that no
    conversation's rows must be in one task.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("tree"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / 64), F.lit(-(1 << 62))))
    counts = table(rows.groupBy("tree", "part").agg(F.count("*").alias("n")), "chat-parts")
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("tree", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    placed = rows.withColumn("nth", nth).join(counts, ["tree", "part"]).withColumn("node", (F.col("before") + F.col("nth")).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select("tree", "node", parent.alias("parent"), F.lit(1.0).alias("score"), "conv_id", "role", "text")


def paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, place) for the `top` best paths of each tree, place counted from the root at 0.

    nodes: tree, node, parent (null or missing: a root) and score (null: 0), unique by (tree, node).
    Paths rank by the sum of scores, then by the smallest leaf. Nodes on or under a cycle have no root
    and are on no path.
    """
    narrow = table(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "chat-nodes")
    exists = narrow.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    first = narrow.join(exists, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    step, n = table(first, "chat-up"), narrow.count()
    parents = step.where("up is not null").select("tree", F.col("up").alias("node"))
    rooted, jumps = step.where("up is null"), []
    # jumps[k]: for the nodes that deep, the ancestor 2^k above, and depth and score of the nodes on the way
    # there. What has reached its root is done and steps no further.
    while step.where("up is not null").limit(1).count() and 1 << len(jumps) <= n:
        active = step.where("up is not null")
        jumps.append(active)
        far = active.unionByName(rooted).select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("d"), F.col("total").alias("t"))
        step = table(active.join(far, ["tree", "up"]).select("tree", "node", F.col("far").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total")), "chat-up")
        rooted = rooted.unionByName(step.where("up is null"))
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    best = F.struct((-F.col("total")).alias("total"), "node", "depth")
    if top == 1:  # partial minima, so a tree with very many leaves is no single task's sort
        ranked = leaves.groupBy("tree").agg(F.min(best).alias("b")).select("tree", F.col("b.node").alias("leaf"), F.lit(1).alias("rank"), "b.depth")
    else:
        # The best of each part of a tree, and then of those.
        parts = F.row_number().over(Window.partitionBy("tree", F.pmod(F.xxhash64("node"), F.lit(PARTS))).orderBy(F.desc("total"), "node"))
        leaves = leaves.withColumn("rank", parts).where(F.col("rank") <= top)
        ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))).where(F.col("rank") <= top).select("tree", F.col("node").alias("leaf"), "rank", "depth")
    on = table(ranked.select("tree", "leaf", "rank", F.col("leaf").alias("node"), (F.col("depth") - 1).alias("place")), "chat-paths")
    for k, jump in enumerate(jumps):
        above = on.join(jump.select("tree", "node", "up"), ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        on = table(on.unionByName(above), "chat-paths")
    return on


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, n_turns, formatted and loss (spans: start, length in code points).

    nodes: tree, node, role, text; null roles and texts are empty. Roles are URL-encoded in the markers.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))
    turns = nodes.join(chosen, ["tree", "node"]).select(
        "tree", "leaf", "rank", "place", F.floor(F.col("place") / CHUNK).alias("chunk"),
        F.concat(head, text, F.lit(END)).alias("out"), F.when(role == "assistant", F.struct(F.length(head).alias("start"), F.length(text).alias("length"))).alias("span"),
    )
    chunk = F.sort_array(F.collect_list(F.struct("place", "out", "span")))
    chunks = turns.groupBy("tree", "leaf", "rank", "chunk").agg(chunk.alias("rows"))
    chunks = chunks.select("tree", "leaf", "rank", "chunk", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda x: x["out"]), "").alias("out"), _spans("rows", lambda x: F.array_compact(F.array(x["span"]))).alias("spans"))
    whole = chunks.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("chunk", "out", "spans", "n"))).alias("rows"))
    return whole.select("tree", "leaf", "rank", F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_turns"), F.array_join(F.transform("rows", lambda x: x["out"]), "").alias("formatted"), _spans("rows", lambda x: x["spans"]).alias("loss"))


def _spans(rows: str, of) -> Column:
    """The spans of all rows, moved by the lengths of the rows before."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        moved = F.transform(of(x), lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["length"].alias("length")))
        return F.struct((a["at"] + F.length(x["out"])).alias("at"), F.concat(a["spans"], moved).alias("spans"))

    return F.aggregate(rows, start, step)["spans"]


def parse(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, read back from formatted and loss."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.substring(x, len(START) + 1, F.length(x)))
    turns = F.transform(bodies, lambda x: let(F.substring_index(x, "\n", 1), lambda r: F.struct(F.url_decode(r).alias("role"), unescape(F.substring(x, F.length(r) + 2, F.length(x))).alias("text"))))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted and loss for each conversation, through chains, paths and format_paths."""
    nodes = table(chains(turns), "chat-turns")
    ids = nodes.where("node = 1").select("tree", "conv_id")
    return format_paths(nodes.select("tree", "node", "role", "text"), paths(nodes)).join(ids, "tree").select("conv_id", "n_turns", "formatted", "loss")
