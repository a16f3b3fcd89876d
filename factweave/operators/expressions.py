"""Expression trees as nested sets: a node's subtree is the rows of its tree whose `pre` lies between its `pre` and `last`.

A table of expressions has the columns tree, node, parent (null at the root), pos (order among siblings, from 0), op and
name, and more if the caller has more. Nodes are numbered for all trees at once; a question about a subtree is then a
join on an interval, whatever the depth. Repeated (tree, node) rows are an error of the source and give undefined numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.graph import cut

#: Trees of depth 16,384 at most.
MOST_ROUNDS = 15


def paths(exprs: DataFrame) -> DataFrame:
    """`exprs` and path: the places of a node's ancestors, and its own, among their siblings, from the root down.

    Pointers double in each round, so a tree of depth d takes as many rounds as d has binary digits. Nodes whose parent is
    missing have no row; parents in a cycle, or deeper trees than MOST_ROUNDS allow, are an error.
    """
    ids = exprs.select("tree", "node", F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), F.array(F.col("pos").cast("int"))).otherwise(F.array().cast("array<int>")).alias("path"))
    now = cut(ids, "paths")
    for _ in range(MOST_ROUNDS):
        if now.where("up is not null").isEmpty():
            return exprs.join(now.drop("up"), ["tree", "node"])
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("path").alias("before"))
        rooted = now.where("up is null")
        moved = now.where("up is not null").join(above, ["tree", "up"])
        now = cut(rooted.unionByName(moved.select("tree", "node", F.col("far").alias("up"), F.concat("before", "path").alias("path"))), "paths")
    raise RuntimeError("paths: no end; are there cycles?")


def _above(rows: DataFrame, *, itself: bool) -> DataFrame:
    """(tree, node, path): a row for each node and each path that leads to a node above it (or to itself)."""
    lengths = F.sequence(F.lit(0), F.size("path") - F.lit(0 if itself else 1))
    there = rows if itself else rows.where(F.size("path") > 0)
    return there.select("tree", "node", F.explode(F.transform(lengths, lambda n: F.slice("path", 1, n))).alias("path"))


def nested(exprs: DataFrame) -> DataFrame:
    """`exprs` with path, depth, pre (from 1, in the order of writing) and last: the numbers of a node and of the last node below it."""
    rows = paths(exprs)
    size = _above(rows, itself=True).groupBy("tree", "path").agg(F.count("*").alias("__size"))
    order = Window.partitionBy("tree").orderBy("path")
    found = rows.withColumn("pre", F.row_number().over(order).cast("long")).join(size, ["tree", "path"])
    return found.withColumns({"depth": F.size("path"), "last": F.col("pre") + F.col("__size") - 1}).drop("__size")


def barred(nodes: DataFrame, through: Column) -> DataFrame:
    """`nodes` (of nested()) and bar: the `pre` of the nearest node above for which `through` doesn't hold, 0 if there is none."""
    walls = nodes.where(~F.coalesce(through, F.lit(False))).select("tree", "path", F.col("pre").alias("__pre"))
    bars = _above(nodes, itself=False).join(walls, ["tree", "path"]).groupBy("tree", "node").agg(F.max("__pre").alias("bar"))
    return nodes.join(bars, ["tree", "node"], "left").withColumn("bar", F.coalesce("bar", F.lit(0).cast("long")))


def with_children(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """`nodes` with first and second: structs of `columns` of the children at places 0 and 1, null where there is none."""
    child = nodes.where("parent is not null and pos < 2").select("tree", F.col("parent").alias("node"), "pos", F.struct(*columns).alias("__child"))
    both = child.groupBy("tree", "node").agg(*[F.max(F.when(F.col("pos") == n, F.col("__child"))).alias(c) for n, c in enumerate(("first", "second"))])
    return nodes.join(both, ["tree", "node"], "left")


def below(tops: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """`tops` (tree, top_pre, top_last and more) with `columns` of each node of their subtrees that no wall between hides (`bar` of barred()); a wall hides what is under it, not itself."""
    inner = nodes.select("tree", "pre", "bar", *columns)
    inside = F.col("pre").between(F.col("top_pre"), F.col("top_last")) & (F.col("bar") < F.col("top_pre"))
    return tops.join(inner, "tree").where(inside).drop("pre", "bar")


def none_below(nodes: DataFrame, tops: DataFrame, found: Column) -> DataFrame:
    """`tops` whose subtree has no visible node for which `found` holds."""
    hits = below(tops.select("tree", "top_pre", "top_last"), nodes.where(found), []).distinct()
    return tops.join(hits, ["tree", "top_pre", "top_last"], "left_anti")
