"""Dominators, dominance frontiers, phi points and def-use edges of many flow graphs at once.

Straight code is contracted to blocks first. A tree that breadth-first search gives over the blocks is then lifted: in each
round the parent of a block becomes its nearest common ancestor with all predecessors, until none moves; what is left is
the dominator tree. Common ancestors are found by jumps of powers of two, kept as an array a block. All graphs hang from
one added root, so there is no loop over them. Node numbers are longs above the lowest one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.components import chains, nodes_of
from factweave.operators.rounds import Rounds

ROOT = -9223372036854775808
#: Ancestors of a block that are looked through at once for a definition, as a power of two.
NEAR = 4


class Dominance(NamedTuple):
    """`members` (node, block, pos), `links` (src, dst) between blocks, `tree` (block, idom, depth, ups): ups[k] is the ancestor 2 ** k above, ROOT at most."""

    members: DataFrame
    links: DataFrame
    tree: DataFrame
    rounds: Rounds


def _lifted(parents: DataFrame, rounds: Rounds) -> DataFrame:
    """(block, idom, depth, ups) of (block, idom); the root is its own parent."""
    now = rounds.cut(parents.select("block", "idom", (F.col("block") != ROOT).cast("long").alias("depth"), F.array("idom").alias("ups")), "ups")
    while not now.where(F.element_at("ups", -1) != ROOT).isEmpty():
        far = now.select(F.col("block").alias("far"), F.col("depth").alias("f_depth"), F.element_at("ups", -1).alias("f_up"))
        new = rounds.cut(now.withColumn("far", F.element_at("ups", -1)).join(far, "far").select("block", "idom", (F.col("depth") + F.col("f_depth")).alias("depth"), F.concat("ups", F.array("f_up")).alias("ups")), "ups")
        rounds.drop(now)
        now = new
    return now


def _jumped(rows: DataFrame, tree: DataFrame, column: str, k: int, where: Column) -> DataFrame:
    """`rows` with `column` (and its d_ depth) moved 2 ** k up where `where` holds."""
    up = tree.select(F.col("block").alias(column), F.element_at("ups", k + 1).alias("up"))
    rows = rows.join(up, column)
    moved = {f"d_{column}": F.when(where, F.col(f"d_{column}") - (1 << k)).otherwise(F.col(f"d_{column}")), column: F.when(where, F.col("up")).otherwise(F.col(column))}
    return rows.withColumns(moved).drop("up")


def common_ancestors(pairs: DataFrame, tree: DataFrame, height: int) -> DataFrame:
    """`pairs` (x, y, ..) with the nearest common ancestor `nca` of x and y and its depth `d_nca`."""
    for c in ("x", "y"):
        pairs = pairs.join(tree.select(F.col("block").alias(c), F.col("depth").alias(f"d_{c}")), c)
    deeper = F.col("d_x") >= F.col("d_y")  # from here on x is the deeper one
    ordered = {c: F.when(deeper, F.col(a)).otherwise(F.col(b)) for c, a, b in (("x", "x", "y"), ("y", "y", "x"), ("d_x", "d_x", "d_y"), ("d_y", "d_y", "d_x"))}
    pairs = pairs.withColumns(ordered)
    for k in reversed(range(height)):
        pairs = _jumped(pairs, tree, "x", k, F.col("d_x") - F.col("d_y") >= (1 << k))
    for k in reversed(range(height)):
        ups = [tree.select(F.col("block").alias(c), F.element_at("ups", k + 1).alias(f"u_{c}")) for c in ("x", "y")]
        pairs = pairs.join(ups[0], "x").join(ups[1], "y")
        apart = F.col("u_x") != F.col("u_y")
        pairs = pairs.withColumn("x", F.when(apart, F.col("u_x")).otherwise(F.col("x"))).withColumn("y", F.when(apart, F.col("u_y")).otherwise(F.col("y")))
        pairs = pairs.withColumn("d_y", F.when(apart, F.col("d_y") - (1 << k)).otherwise(F.col("d_y"))).drop("u_x", "u_y")
    pairs = pairs.join(tree.select(F.col("block").alias("x"), F.col("idom").alias("above")), "x")
    same = F.col("x") == F.col("y")
    return pairs.withColumn("nca", F.when(same, F.col("x")).otherwise(F.col("above"))).withColumn("d_nca", F.when(same, F.col("d_y")).otherwise(F.col("d_y") - 1)).drop("x", "y", "d_x", "d_y", "above")


def _spanning(links: DataFrame, rounds: Rounds) -> DataFrame:
    """(block, idom): a breadth-first tree from the root over what it reaches, each block under its smallest predecessor."""
    front = rounds.cut(links.sparkSession.range(1).select(F.lit(ROOT).alias("block"), F.lit(ROOT).alias("idom")), "front")
    found = front
    for step in range(1, 1_000_000):
        new = links.join(front.select(F.col("block").alias("src")), "src").groupBy(F.col("dst").alias("block")).agg(F.min("src").alias("idom"))
        front = rounds.cut(new.join(found, "block", "left_anti"), "front")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
        if step % 10 == 0:
            found = rounds.cut(found, "found")
    raise RuntimeError("dominance: no end of paths")


def dominance(edges: DataFrame, entries: DataFrame, rounds: Rounds | None = None) -> Dominance:
    """The dominator tree of `edges` (src, dst) from `entries` (node), over what they reach. Rounds of the search are the longest of the shortest
    paths in blocks, rounds of lifting as few as loops are nested; a round's joins are as many as the tree's depth has binary digits."""
    rounds = rounds or Rounds(edges.sparkSession, "dominance")
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    edges = rounds.cut(edges.unionByName(entries.where("node is not null").select(F.lit(ROOT).alias("src"), F.col("node").alias("dst"))).distinct(), "edges")
    members = chains(edges, nodes_of(edges), rounds)
    members = rounds.cut(members.where("not ring").select("node", F.col("chain").alias("block"), "pos"), "members")
    ends = [members.select(F.col("node").alias(s), F.col("block").alias(f"b_{s}"), F.col("pos").alias(f"p_{s}")) for s in ("src", "dst")]
    both = edges.join(ends[0], "src").join(ends[1], "dst")
    inner = (F.col("b_src") == F.col("b_dst")) & (F.col("p_dst") == F.col("p_src") + 1)
    links = rounds.cut(both.where(~inner).select(F.col("b_src").alias("src"), F.col("b_dst").alias("dst")).distinct(), "links")
    now = rounds.cut(_spanning(links, rounds), "tree")
    links = rounds.cut(links.join(now.select(F.col("block").alias("src")), "src", "left_semi"), "links")  # of reached blocks only
    joins = links.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    asked = rounds.cut(links.join(joins, "dst", "left_semi"), "asked")
    while True:
        tree = _lifted(now, rounds)
        height = tree.agg(F.max(F.size("ups"))).first()[0]
        pairs = asked.select(F.col("dst").alias("block"), F.col("src").alias("y")).join(tree.select("block", F.col("idom").alias("x")), "block")
        above = common_ancestors(pairs, tree, height).groupBy("block").agg(F.min(F.struct("d_nca", "nca")).alias("top")).select("block", F.col("top.nca").alias("nca"))
        new = rounds.cut(tree.select("block", "idom").join(above, "block", "left").select("block", F.coalesce("nca", "idom").alias("idom"), (F.col("nca") != F.col("idom")).alias("moved")), "tree")
        if new.where("moved").isEmpty():
            return Dominance(members.join(new.select("block"), "block", "left_semi"), links, tree, rounds)
        now = new.select("block", "idom")


def immediate_dominators(found: Dominance) -> DataFrame:
    """(node, idom) of every reached node; null for entries."""
    before = Window.partitionBy("block").orderBy("pos")
    last = found.members.groupBy("block").agg(F.max_by("node", "pos").alias("end"))
    nodes = found.members.withColumn("up", F.lag("node").over(before))
    heads = found.tree.select("block", F.col("idom").alias("above")).join(last.select(F.col("block").alias("above"), "end"), "above")
    rows = nodes.join(heads.select("block", "end"), "block").where(F.col("node") != ROOT)
    idom = F.coalesce("up", "end")
    return rows.select("node", F.when(idom != ROOT, idom).alias("idom"))


def block_frontiers(found: Dominance) -> DataFrame:
    """(block, join): the joins at which a block's dominance ends. Every node of a block has them."""
    rounds, tree = found.rounds, found.tree
    joins = found.links.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    at = tree.select("block", "idom", "depth", "ups")
    stop = at.select(F.col("block").alias("join"), F.col("idom").alias("stop")).join(at.select(F.col("block").alias("stop"), F.col("depth").alias("stop_depth")), "stop").drop("stop")
    rows = found.links.join(joins, "dst", "left_semi").select(F.col("dst").alias("join"), F.col("src").alias("block")).join(stop, "join")
    rows = rounds.cut(rows.join(at.select("block", "depth"), "block").where("depth > stop_depth").select("block", "join", "stop_depth").distinct(), "frontier")
    for k in range(tree.agg(F.max(F.size("ups"))).first()[0]):
        up = at.where(F.col("depth") > (1 << k)).select("block", (F.col("depth") - (1 << k)).alias("depth"), F.element_at("ups", k + 1).alias("up"))
        more = rows.join(up, "block").where("depth > stop_depth").select(F.col("up").alias("block"), "join", "stop_depth")
        if more.isEmpty():
            break
        new = rounds.cut(rows.unionByName(more).distinct(), "frontier")
        rounds.drop(rows)
        rows = new
    return rows.select("block", "join")


def frontiers(found: Dominance) -> DataFrame:
    """(node, join): dominance frontiers of all reached nodes."""
    return found.members.where(F.col("node") != ROOT).join(block_frontiers(found), "block").select("node", "join")


def phi_points(found: Dominance, defs: DataFrame) -> DataFrame:
    """(node, loc): joins at which different definitions of a location meet, by iterated frontiers; only new ones go on in a round."""
    rounds = found.rounds
    front_of = rounds.cut(block_frontiers(found), "frontiers")
    new = found.members.join(defs.select("node", "loc").distinct(), "node").select("block", "loc").distinct()
    phis = None
    while True:
        met = front_of.join(new, "block").select(F.col("join").alias("block"), "loc").distinct()
        new = rounds.cut(met if phis is None else met.join(phis, ["block", "loc"], "left_anti"), "phi")
        if new.isEmpty():
            break
        phis = new if phis is None else phis.unionByName(new)
    return (new if phis is None else phis).select(F.col("block").alias("node"), "loc")


def def_use(found: Dominance, defs: DataFrame, uses: DataFrame, phis: DataFrame | None = None) -> DataFrame:
    """(src, dst, loc): from each use's nearest dominating definition or phi point, and into each phi point from what reaches the end of every predecessor.

    `defs` and `uses` are (node, loc); null ones are left out, and nodes that no entry reaches have no edges. A node uses what held before it, so its own definition
    isn't meant; a phi point's own use isn't drawn, as its edges go into the phi. A use that nothing defines has no edge.
    """
    rounds = found.rounds
    phis = rounds.cut(phi_points(found, defs) if phis is None else phis, "phis")
    there = "node is not null and loc is not null"
    rows = [
        phis.join(found.members, "node").select("node", "block", "loc", F.lit(-1).cast("long").alias("at"), F.lit(True).alias("is_def")),
        found.members.join(uses.where(there).select("node", "loc").distinct(), "node").select("node", "block", "loc", (2 * F.col("pos")).alias("at"), F.lit(False).alias("is_def")),
        found.members.join(defs.where(there).select("node", "loc").distinct(), "node").select("node", "block", "loc", (2 * F.col("pos") + 1).alias("at"), F.lit(True).alias("is_def")),
    ]
    before = Window.partitionBy("block", "loc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows[0].unionByName(rows[1]).unionByName(rows[2])
    seen = rounds.cut(seen.withColumn("src", F.last(F.when(F.col("is_def"), F.col("node")), ignorenulls=True).over(before)), "seen")
    last = rounds.cut(seen.where("is_def").groupBy("block", "loc").agg(F.max_by("node", "at").alias("src")), "last")
    used = seen.where("not is_def")
    inside = used.where("src is not null and (src <> node or at > 0)").select("src", F.col("node").alias("dst"), "loc")
    asks = used.where("src is null").select("block", "loc", F.col("node").alias("dst"))
    into = phis.join(found.links.select(F.col("dst").alias("node"), F.col("src").alias("block")), "node").join(last, ["block", "loc"], "left")
    operands = into.where("src is not null").select("src", F.col("node").alias("dst"), "loc")
    asks = rounds.cut(asks.unionByName(into.where("src is null").select("block", "loc", F.col("node").alias("dst"))), "asks")
    return inside.unionByName(operands).unionByName(_answered(found, asks, last)).distinct()


def _answered(found: Dominance, asks: DataFrame, last: DataFrame) -> DataFrame:
    """(src, dst, loc) for `asks` (block, loc, dst) from the nearest block above `block` in `last` (block, loc, src); 2 ** NEAR ancestors a round."""
    rounds, tree = found.rounds, found.tree
    near = rounds.cut(tree.where(F.col("block") != ROOT).select("block", F.col("idom").alias("above"), F.lit(1).alias("dist")), "near")
    for k in range(NEAR):
        more = near.select("block", "above", "dist").join(near.select(F.col("block").alias("above"), F.col("above").alias("far"), F.col("dist").alias("more")), "above")
        more = more.where(F.col("dist") == (1 << k)).select("block", F.col("far").alias("above"), (F.col("dist") + F.col("more")).alias("dist"))
        new = rounds.cut(near.unionByName(more), "near")
        rounds.drop(near)
        near = new
    marks = last.select(F.col("block").alias("above"), "loc", "src")
    open_, answers = rounds.cut(asks.select("block", "loc").distinct().withColumn("at", F.col("block")), "open"), []
    while not open_.isEmpty():
        hit = open_.join(near.select(F.col("block").alias("at"), "above", "dist"), "at").join(marks, ["above", "loc"])
        hit = rounds.cut(hit.groupBy("block", "loc").agg(F.min_by("src", "dist").alias("src")), "hit")
        answers.append(hit)
        far = near.where(F.col("dist") == (1 << NEAR)).select(F.col("block").alias("at"), "above")
        rest = open_.join(hit, ["block", "loc"], "left_anti").join(far, "at").select("block", "loc", F.col("above").alias("at"))
        open_ = rounds.cut(rest, "open")
    if not answers:
        return asks.select(F.col("dst").alias("src"), "dst", "loc").limit(0)
    known = answers[0]
    for a in answers[1:]:
        known = known.unionByName(a)
    return asks.join(known, ["block", "loc"]).select("src", "dst", "loc")
