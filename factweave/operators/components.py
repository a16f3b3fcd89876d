"""Strong components and weak topological orders of large graphs, without a closure.

Chains are contracted first: an edge from a node without another successor to a node without another predecessor joins
two nodes that are on the same cycles, so its ends become one. What is left is trimmed of nodes that no edge enters or
leaves, and coloured: each node takes the smallest node that reaches it; those of a colour that also lead back to its
smallest node are its component. Edges between colours are on no cycle and go; the rest is coloured again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.ranking import ranked
from factweave.operators.rounds import Rounds, merged


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def chains(edges: DataFrame, nodes: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, chain, pos, ring): the first node of each node's chain and the steps from it; of a cycle that nothing enters or leaves (ring), its
    smallest node and 0. `edges` are distinct (src, dst) without nulls, `nodes` (node) hold all their ends. Pointers double, so rounds are a chain's length in powers of two."""
    one_out = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select("src", "dst")
    one_in = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1").select("src", "dst")
    links = one_out.join(merged(one_in), ["src", "dst"]).where("src <> dst")
    start = nodes.join(merged(links.select(F.col("dst").alias("node"), F.col("src").alias("up"))), "node", "left")
    now = rounds.cut(start.select("node", F.coalesce("up", "node").alias("at"), F.col("up").isNull().alias("there"), F.col("up").isNotNull().cast("long").alias("pos"), F.least("node", "up").alias("least")), "chains")
    before = None
    while True:
        found = now.where("not there").agg(F.count("*"), F.bit_xor(F.xxhash64("node", "least"))).first()
        if found == before or not found[0]:
            break
        before = found
        on = now.select(F.col("node").alias("at"), F.col("at").alias("o_at"), F.col("there").alias("o_there"), F.col("pos").alias("o_pos"), F.col("least").alias("o_least"))
        far = now.where("not there").join(merged(on), "at").select("node", F.col("o_at").alias("at"), F.col("o_there").alias("there"), (F.col("pos") + F.col("o_pos")).alias("pos"), F.least("least", "o_least").alias("least"))
        new = rounds.cut(now.where("there").unionByName(far), "chains")
        rounds.drop(now)
        now = new
    return now.select("node", F.when(F.col("there"), F.col("at")).otherwise(F.col("least")).alias("chain"), F.when(F.col("there"), F.col("pos")).otherwise(0).alias("pos"), (~F.col("there")).alias("ring"))


def _coloured(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, label): the smallest node that leads to each; only labels that changed go on, two edges a round."""
    now = front = rounds.cut(nodes_of(edges).withColumn("label", F.col("node")), "labels")
    while True:
        once = edges.join(merged(front.select(F.col("node").alias("src"), "label")), "src").select(F.col("dst").alias("node"), "label")
        twice = edges.join(merged(once.groupBy(F.col("node").alias("src")).agg(F.min("label").alias("label"))), "src").select(F.col("dst").alias("node"), "label")
        sent = once.unionByName(twice).groupBy("node").agg(F.min("label").alias("new"))
        both = now.join(merged(sent), "node", "left").select("node", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved"))
        new = rounds.cut(both, "labels")
        rounds.drop(now)
        now, front = new, new.where("moved").select("node", "label")
        if front.isEmpty():
            return now.select("node", "label")


def _led_back(edges: DataFrame, starts: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, label) of all from which edges (src, dst, label) lead to `starts` under the same label; two edges a round."""
    found = front = rounds.cut(starts, "back")
    for step in range(1, 1_000_000):
        back = lambda rows: edges.join(merged(rows.select(F.col("node").alias("dst"), "label")), ["dst", "label"]).select(F.col("src").alias("node"), "label")
        once = back(front)
        front = rounds.cut(once.unionByName(back(once)).distinct().join(merged(found), ["node", "label"], "left_anti"), "back")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
        if step % 10 == 0:
            found = rounds.cut(found, "back")
    raise RuntimeError("components: no end of paths")


def cyclic_nodes(edges: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(node, scc): every node on a cycle and its component's smallest node. Null ends have no edges; none give no rows."""
    rounds = rounds or Rounds(edges.sparkSession, "scc")
    edges = rounds.cut(_clean(edges), "edges")
    member = rounds.cut(chains(edges, nodes_of(edges), rounds), "members")
    ends = [member.select(F.col("node").alias(side), F.col("chain").alias(f"c_{side}"), F.col("pos").alias(f"p_{side}")) for side in ("src", "dst")]
    between = edges.join(merged(ends[0]), "src").join(merged(ends[1]), "dst")
    # An edge within a chain but to the next node closes a cycle over all of it: its ends have no other edges.
    inner = (F.col("c_src") == F.col("c_dst")) & (F.col("p_dst") == F.col("p_src") + 1)
    between = rounds.cut(between.where(~inner).select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct(), "between")
    own = [between.where("src = dst").select(F.col("src").alias("chain"), F.col("src").alias("label"))]
    left = between.where("src <> dst")
    size = left.count()
    while size:
        inner = left.join(merged(left.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        trimmed = rounds.cut(inner.join(merged(inner.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").select("src", "dst"), "left")
        rounds.drop(left)
        left, before, size = trimmed, size, trimmed.count()
        if not size or size < 0.5 * before:
            continue
        label = _coloured(left, rounds)
        same = left.join(merged(label.select(F.col("node").alias("src"), "label")), "src").join(merged(label.select(F.col("node").alias("dst"), F.col("label").alias("l_dst"))), "dst").where("label = l_dst")
        same = rounds.cut(same.select("src", "dst", "label"), "same")
        starts = label.where("node = label").join(merged(same.select(F.col("dst").alias("node")).distinct()), "node", "left_semi")
        found = _led_back(same, starts, rounds)
        own.append(found.select(F.col("node").alias("chain"), "label"))
        gone = found.select("node")
        new = same.join(merged(gone.withColumnRenamed("node", "src")), "src", "left_anti").join(merged(gone.withColumnRenamed("node", "dst")), "dst", "left_anti")
        left = rounds.cut(new.select("src", "dst"), "left")
        size = left.count()
    on_cycle = own[0]
    for o in own[1:]:
        on_cycle = on_cycle.unionByName(o)
    # A chain with an edge to itself may lie on longer cycles too; a start without a way back is on none.
    on_cycle = on_cycle.groupBy("chain").agg(F.min("label").alias("label"))
    found = rounds.cut(member.join(merged(on_cycle), "chain").select("node", "label"), "cyclic")
    least = found.groupBy("label").agg(F.min("node").alias("scc"))
    return rounds.cut(found.join(merged(least), "label").select("node", "scc"), "cyclic")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc): the smallest node on a common cycle, itself without one."""
    nodes = nodes_of(edges.where("src is not null and dst is not null"))
    return nodes.join(merged(cyclic_nodes(edges)), "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def levels(edges: DataFrame, nodes: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, level, pos): of an acyclic graph, the most chains on a path to a node's chain, and its place in it; edges lead upwards in (level, pos)."""
    member = rounds.cut(chains(edges, nodes, rounds), "level-chains")
    ends = [member.select(F.col("node").alias(side), F.col("chain").alias(f"c_{side}")) for side in ("src", "dst")]
    between = rounds.cut(edges.join(merged(ends[0]), "src").join(merged(ends[1]), "dst").where("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct(), "level-edges")
    now = front = rounds.cut(member.select(F.col("chain").alias("node")).distinct().withColumn("level", F.lit(0).cast("long")), "levels")
    while True:
        sent = between.join(merged(front.select(F.col("node").alias("src"), "level")), "src").groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("new"))
        new = rounds.cut(now.join(merged(sent), "node", "left").select("node", F.greatest("level", "new").alias("level"), (F.col("new") > F.col("level")).alias("moved")), "levels")
        rounds.drop(now)
        now, front = new, new.where("moved").select("node", "level")
        if front.isEmpty():
            return member.join(merged(now.select(F.col("node").alias("chain"), "level")), "chain").select("node", "level", "pos")


def heads(edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(scc, node): of the nodes that edges enter a component at, the one with the most predecessors in it, the smallest of equal ones; without any, the smallest node."""
    ends = [cyclic.select(F.col("node").alias(side), F.col("scc").alias(f"s_{side}")) for side in ("src", "dst")]
    into = edges.join(merged(ends[1]), "dst").join(merged(ends[0]), "src", "left")
    inside = F.coalesce(F.col("s_src") == F.col("s_dst"), F.lit(False))
    score = into.groupBy("s_dst", "dst").agg(F.count_if(inside).alias("inner"), F.count_if(~inside).alias("entered"))
    best = F.struct((F.col("entered") > 0).cast("int").alias("entry"), F.when(F.col("entered") > 0, F.col("inner")).otherwise(0).alias("inner"))
    top = score.withColumn("best", best)
    most = top.groupBy("s_dst").agg(F.max("best").alias("best"))
    return top.join(merged(most), ["s_dst", "best"]).groupBy(F.col("s_dst").alias("scc")).agg(F.min("dst").alias("node"))


def loop_heads(edges: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(node): the heads of all components, of the components within them without edges into their heads, and so on, and nodes with an edge to
    themselves. Every cycle holds one."""
    rounds = rounds or Rounds(edges.sparkSession, "heads")
    now = rounds.cut(_clean(edges), "edges")
    found = now.where("src = dst").select(F.col("src").alias("node"))
    now = now.where("src <> dst")
    while True:
        cyclic = cyclic_nodes(now, rounds)
        if cyclic.isEmpty():
            return found.distinct()
        head = rounds.cut(heads(now, cyclic), "heads")
        found = found.unionByName(head.select("node"))
        now = rounds.cut(within(now, cyclic, head), "now")


def within(edges: DataFrame, cyclic: DataFrame, head: DataFrame) -> DataFrame:
    """The edges between nodes of one component but those into its head."""
    ends = [cyclic.select(F.col("node").alias(side), F.col("scc").alias(f"s_{side}")) for side in ("src", "dst")]
    inside = edges.join(merged(ends[0]), "src").join(merged(ends[1]), "dst").where("s_src = s_dst")
    return inside.join(merged(head.select(F.col("node").alias("dst"))), "dst", "left_anti").select("src", "dst")


def weak_topological_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, order, is_head, depth): orders from 1 in which every edge leads on but those back to a head of a component around it.

    A component is laid out from its head; edges into the head are cut and the rest is split into components again, so
    `depth` is the number of components around a node. A node with an edge to itself is a head. Components of equal level
    are ordered by their smallest node. Rounds grow with nesting and with the length of paths between chains. `nodes` may
    add some without edges.
    """
    rounds = Rounds(edges.sparkSession, "wto")
    now = rounds.cut(_clean(edges), "edges")
    here = nodes_of(now) if nodes is None else nodes_of(now).unionByName(nodes.select("node")).distinct()
    here = rounds.cut(here.withColumn("key", F.array().cast("array<bigint>")), "here")
    loops = rounds.cut(now.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop")), "loops")
    done, found_heads = [], [loops.select("node")]
    now = rounds.cut(now.where("src <> dst"), "now")
    while True:
        cyclic = cyclic_nodes(now, rounds)
        part = rounds.cut(here.join(merged(cyclic), "node", "left").select("node", "key", F.coalesce("scc", "node").alias("part"), F.col("scc").isNotNull().alias("cyclic")), "parts")
        ends = [part.select(F.col("node").alias(side), F.col("part").alias(f"p_{side}")) for side in ("src", "dst")]
        both = rounds.cut(now.join(merged(ends[0]), "src").join(merged(ends[1]), "dst"), "both")
        over = both.where("p_src <> p_dst").select(F.col("p_src").alias("src"), F.col("p_dst").alias("dst")).distinct()
        level = levels(rounds.cut(over, "over"), part.select(F.col("part").alias("node")).distinct(), rounds)
        placed = part.join(merged(level.select(F.col("node").alias("part"), "level", "pos")), "part")
        # Within one level of one component: chains by their first node, then places in a chain.
        placed = rounds.cut(placed.select("node", F.concat("key", F.array(*[F.col(c).cast("long") for c in ("level", "pos", "part")])).alias("key"), "cyclic", "part"), "placed")
        done.append(placed.where("not cyclic").select("node", "key"))
        if cyclic.isEmpty():
            break
        head = rounds.cut(heads(now, cyclic), "heads")
        found_heads.append(head.select("node"))
        here = placed.where("cyclic").select("node", "key")
        now = both.where("p_src = p_dst").join(merged(head.select(F.col("node").alias("dst"))), "dst", "left_anti").select("src", "dst")
        now = rounds.cut(now, "now")
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    top = found_heads[0]
    for h in found_heads[1:]:
        top = top.unionByName(h)
    rows = rows.join(merged(top.distinct().withColumn("is_head", F.lit(True))), "node", "left")
    rows = rows.select("node", F.coalesce("is_head", F.lit(False)).alias("is_head"), (F.size("key") / 3 - 1).cast("int").alias("depth"), "key")
    return ranked(rows, [F.asc("key")]).select("node", F.col("rank").alias("order"), "is_head", "depth")
