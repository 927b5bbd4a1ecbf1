"""Conversations from reply trees: root-to-leaf paths by self-joins, ranked by score, formatted with a loss mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomframe.llm.common import durable

#: Marks of the template. A turn is OPEN role CLOSE text END; escaped texts hold none of the characters < [ ].
OPEN, CLOSE, END = "<s>[", "]", "</s>"
#: What stands for each escaped character. The escape character comes first when escaping and last when reading.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\d"))


def escape(text: Column) -> Column:
    """Replaces the characters that marks are made of; reversible for every text."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), ESCAPES[:0:-1] + ESCAPES[:1], text)


def _join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A shuffled join. Tables of ids and counters are tiny as files, from which the planner would take them for small
    and broadcast them, although their rows are as many as the input's."""
    return a.join(b.hint("merge"), on, how)


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """The nodes of the best root-to-leaf paths of nodes(tree, node, parent, score): tree, path, pos, node, path_score.

    Self-joins double the reach of every node's pointer to an ancestor, so a path of d nodes takes log2(d) rounds.
    A leaf's path is scored by the mean score of its nodes (null counts as 0); of equal scores the smallest leaf
    wins. A parent that is null or absent makes its node a root. Nodes are distinct in a tree; nodes on a cycle have
    no root and are in no path. Nodes whose tree is null make a tree of their own. No rows: no paths.
    """
    return _best_paths(_wrapped(nodes), per_tree).withColumn("tree", F.col("tree.of"))


def _wrapped(nodes: DataFrame) -> DataFrame:
    """nodes with the tree in a struct, so that a null tree equals itself in joins."""
    return nodes.withColumn("tree", F.struct(F.col("tree").alias("of")))


def _best_paths(nodes: DataFrame, per_tree: int) -> DataFrame:
    own = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("s"), "parent")
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = _join(own, there, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "s", F.lit(1).cast("long").alias("d"))
    jumps = [durable(up)]
    pending, before = jumps[0].filter("up is not null").count(), None
    while pending and pending != before:
        last = jumps[-1]
        far = last.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("s").alias("s2"), F.col("d").alias("d2"))
        step = _join(last.filter("up is not null"), far, ["tree", "up"])  # rows that have reached their root stay as they are
        step = step.select("tree", "node", F.col("up2").alias("up"), (F.col("s") + F.col("s2")).alias("s"), (F.col("d") + F.col("d2")).alias("d"))
        jumps.append(durable(last.filter("up is null").select("tree", "node", "up", "s", "d").unionByName(step)))
        pending, before = jumps[-1].filter("up is not null").count(), pending
    total = jumps[-1].filter("up is null")
    inner = nodes.filter("parent is not null").select("tree", F.col("parent").alias("node"))
    leaves = _join(total, inner, ["tree", "node"], "left_anti").withColumn("path_score", F.col("s") / F.col("d"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "node"))
    chosen = durable(leaves.withColumn("path", rank).filter(F.col("path") <= per_tree).select("tree", "path", "node", "path_score"))
    for jump in jumps[:-1] if len(jumps) > 1 else []:
        above = _join(chosen, jump.filter("up is not null").select("tree", "node", "up"), ["tree", "node"]).select("tree", "path", F.col("up").alias("node"), "path_score")
        chosen = durable(chosen.unionByName(above))  # else the plan doubles at each step
    return _join(chosen, total.select("tree", "node", "d"), ["tree", "node"]).select("tree", "path", F.col("d").alias("pos"), "node", "path_score")


def format_paths(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """turns(conv, pos, role, text) as conv, formatted, mask: spans (start, end) of code points to learn from.

    Each turn is marked and escaped; the mask covers the text of every turn of the role `learn`. Null roles and
    texts count as empty.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    rows = turns.select("conv", "pos", F.col("role").eqNullSafe(learn).alias("hot"), F.concat(F.lit(OPEN), role, F.lit(CLOSE)).alias("head"), text.alias("body"))
    rows = rows.withColumn("len", F.length("head") + F.length("body") + len(END))
    before = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("len").over(before), F.lit(0)) + F.length("head"))
    out = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "hot", "at", F.length("body").alias("n"), F.concat("head", "body", F.lit(END)).alias("turn")))).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["hot"]), lambda x: F.struct(x["at"].alias("start"), (x["at"] + x["n"]).alias("end")))
    return out.select("conv", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and learnt (the texts under the mask, unescaped), both read from the formatted text."""
    parts = F.filter(F.split("formatted", END), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), CLOSE, 1)).alias("role"), unescape(F.substring_index(x, CLOSE, -1)).alias("text")
    )
    cut = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.withColumns({"turns": F.transform(parts, turn), "learnt": cut})


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as nodes: each turn answers the one before it.

    Rows that repeat a turn follow one another by role and text; null turns come first.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_trees(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """The best paths of nodes(tree, node, parent, score, role, text): conv (tree, path), formatted, mask."""
    nodes = durable(_wrapped(nodes))
    paths = _best_paths(nodes, per_tree)
    turns = _join(paths, nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    return format_paths(turns.select(F.struct(F.col("tree.of").alias("tree"), "path").alias("conv"), "pos", "role", "text"))
