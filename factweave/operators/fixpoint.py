"""Least fixpoints of interval states on a graph of flows, as iterated joins of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import interval as I
from factweave.operators.graph import cut


def _sent(states: DataFrame, flows: DataFrame) -> DataFrame:
    """(node, new_lo, new_hi): what `states` send along `flows`, joined at its node. Only bounds are shuffled, combined before."""
    rows = flows.join(states.select(F.col("node").alias("src"), "lo", "hi"), "src")
    moved = I.meet(I.plus(I.Interval(F.col("lo"), F.col("hi")), I.Interval(F.col("add"), F.col("add"))), I.Interval(F.col("from"), F.col("to")))
    return rows.select(F.col("dst").alias("node"), *moved.alias("new_lo", "new_hi")).groupBy("node").agg(F.min("new_lo").alias("new_lo"), F.max("new_hi").alias("new_hi")).where("new_lo is not null")


def fixpoint(flows: DataFrame, start: DataFrame, thresholds: list[int] = (), delay: int = 3, narrowing: int = 10) -> DataFrame:
    """(node, lo, hi) with no bottoms: the least intervals that hold `start` (node, lo, hi) and, along each flow (src, dst, add, from, to), what src holds
    plus `add`, as far as it lies within [from, to].

    Nodes whose state grew send it on in the next round. From round `delay` on bounds that grow are widened to `thresholds` or infinity,
    so rounds end; rounds of narrowing then take widened bounds back to what all flows and `start` give, until nothing changes or after
    `narrowing` of them (the result holds all values either way). Null nodes and bounds give nothing, an empty `start` no rows.
    """
    there = "node is not null and lo is not null and lo <= hi"
    links = cut(flows.where("src is not null and dst is not null").select("src", "dst", *[F.col(c).cast("long").alias(c) for c in ("add", "from", "to")]).distinct(), "flows")
    own = cut(start.where(there).groupBy("node").agg(F.min("lo").cast("long").alias("lo"), F.max("hi").cast("long").alias("hi")), "start")
    now, changed = own, own
    old, new = I.Interval(F.col("lo"), F.col("hi")), I.Interval(F.col("new_lo"), F.col("new_hi"))
    for step in range(1, 1_000_000):
        both = now.join(_sent(changed, links), "node", "full")
        grown = I.widen(old, I.join(old, new), list(thresholds)) if step >= delay else I.join(old, new)
        rows = cut(both.select("node", *grown.alias(), (~I.le(new, old)).alias("grew")), "fixpoint")
        now, changed = rows.select("node", "lo", "hi"), rows.where("grew").select("node", "lo", "hi")
        if changed.isEmpty():
            break
    for _ in range(narrowing):
        all_of = _sent(now, links).select("node", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi")).unionByName(own)
        all_of = all_of.groupBy("node").agg(F.min("lo").alias("new_lo"), F.max("hi").alias("new_hi"))
        less = I.narrow(old, I.meet(new, old), list(thresholds))
        rows = cut(now.join(all_of, "node").select("node", *less.alias(), (~I.eq(less, old)).alias("shrank")).where("lo is not null"), "fixpoint")
        now = rows.select("node", "lo", "hi")
        if rows.where("shrank").isEmpty():
            break
    return now
