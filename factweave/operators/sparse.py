"""Fixpoints over def-use edges with commands: values move only along edges that carry their location.

State is what nodes define: (node, loc, lo, hi). A round recomputes the nodes that edges lead to from what changed; it
pulls their inputs along all their edges, runs their commands and writes what grew as a table of its own. Those tables
together are the state, since values only grow; after every few rounds they become one. Loop heads widen, so rounds end;
rounds of narrowing then take widened bounds back. Rounds are committed with a manifest and can be resumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import interval as I
from factweave.operators.rounds import Rounds, merged

#: node and loc: what a command defines; op and its operands, each a location that the node uses or a constant interval; weak: the old value stays possible.
COMMANDS = "node long, loc string, op string, x_loc string, x_lo long, x_hi long, y_loc string, y_lo long, y_hi long, weak boolean"
ARITHMETIC = {"plus": I.plus, "minus": I.minus, "times": I.times, "divide": I.divide}
#: Assumptions: the part of x for which it can hold against y.
ASSUMED = ("lt", "le", "gt", "ge", "eq", "ne")
COMPACT = 5


def result_of(op: Column, x: I.Interval, y: I.Interval, ops: list[str]) -> I.Interval:
    """x for `copy`, x op y for arithmetic, x pruned for assumptions; any other op gives all values. `ops` are those that occur.

    Operands go into a lambda, so that each is computed once and a plan doesn't hold copies of it for every use in every op.
    """
    forms = {"copy": lambda x, y: x, **ARITHMETIC, **{o: lambda x, y, o=o: I.prune(o, x, y) for o in ASSUMED}}

    def chosen(r: Column) -> Column:
        lo, hi = F.lit(I.NEG), F.lit(I.POS)
        for name in ops:
            value = forms[name](I.Interval(r["x_lo"], r["x_hi"]), I.Interval(r["y_lo"], r["y_hi"]))
            lo, hi = F.when(r["op"] == name, value.lo).otherwise(lo), F.when(r["op"] == name, value.hi).otherwise(hi)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    rows = F.array(F.struct(op.alias("op"), *x.alias("x_lo", "x_hi"), *y.alias("y_lo", "y_hi")))
    value = F.element_at(F.transform(rows, chosen), 1)
    return I.Interval(value["lo"], value["hi"])


def joined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node", "loc").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def pulled(edges: DataFrame, state: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, loc, lo, hi): what edges (src, dst, loc) bring to each of `nodes`, all if None; bottoms are absent."""
    into = edges if nodes is None else edges.join(merged(nodes.select(F.col("node").alias("dst"))), "dst", "left_semi")
    return joined(into.join(merged(state.withColumnRenamed("node", "src")), ["src", "loc"]).select(F.col("dst").alias("node"), "loc", "lo", "hi"))


def known_ops(commands: DataFrame) -> list[str]:
    return [r.op for r in commands.where(F.col("op").isin("copy", *ARITHMETIC, *ASSUMED)).select("op").distinct().orderBy("op").collect()]


def defined(commands: DataFrame, inputs: DataFrame, ops: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """(node, loc, lo, hi) after the commands of `nodes`, all if None; locations without a command pass through."""
    ran = commands if nodes is None else commands.join(merged(nodes.select("node")), "node", "left_semi")
    for side, loc in (("x", "x_loc"), ("y", "y_loc"), ("old", "loc")):
        ran = ran.join(merged(inputs.select("node", F.col("loc").alias(loc), F.col("lo").alias(f"{side}_in_lo"), F.col("hi").alias(f"{side}_in_hi"))), ["node", loc], "left")
    operand = lambda s: I.interval(F.when(F.col(f"{s}_loc").isNull(), F.col(f"{s}_lo")).otherwise(F.col(f"{s}_in_lo")), F.when(F.col(f"{s}_loc").isNull(), F.col(f"{s}_hi")).otherwise(F.col(f"{s}_in_hi")))
    got = ran.withColumn("got", F.struct(*result_of(F.col("op"), operand("x"), operand("y"), ops).alias())).select("node", "loc", "got.lo", "got.hi")
    held = ran.where("weak").select("node", "loc", F.col("old_in_lo").alias("lo"), F.col("old_in_hi").alias("hi"))
    out = got.unionByName(held).where("lo <= hi")
    passed = inputs.join(merged(commands.select("node", "loc")), ["node", "loc"], "left_anti")
    return joined(out.unionByName(passed))


def sparse_fixpoint(edges: DataFrame, commands: DataFrame, heads: DataFrame, thresholds: list[int] = (), narrowing: int = 10, home: str | None = None, stop_after: int | None = None) -> DataFrame:
    """(node, loc, lo, hi): what each node defines, at a fixpoint; bottoms are absent.

    `edges` are (src, dst, loc), `commands` as in COMMANDS, `heads` (node) must cut every cycle of edges. Nulls in edges
    and in a command's node, loc or op leave the row out; a location of a node with several commands gets the join of
    their results. `narrowing` rounds at most follow, fewer if nothing changes; the state holds all values after any of
    them. With a `home` every round is committed there, and a run that finds committed rounds goes on after the last;
    `stop_after` ends the run with an error after so many rounds, for tests of that.
    """
    rounds = Rounds(edges.sparkSession, "sparse", home)
    steps, resumed = list(thresholds), rounds.resumed()
    if resumed:
        tables, facts = resumed
        links, ran, tops, parts, changed = tables["links"][0], tables["commands"][0], tables["heads"][0], tables["parts"], tables["changed"][0]
    else:
        facts = {"phase": "widen"}
        links = rounds.cut(edges.where("src is not null and dst is not null and loc is not null").select("src", "dst", "loc").distinct(), "links")
        there = "node is not null and loc is not null and op is not null"
        ran = rounds.cut(commands.where(there).withColumn("weak", F.coalesce("weak", F.lit(False))).distinct(), "commands")
        tops = rounds.cut(heads.where("node is not null").select("node").distinct().withColumn("head", F.lit(True)), "heads")
        none = ran.limit(0).select("node", "loc", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
        changed = rounds.cut(joined(defined(ran, none, known_ops(ran)).join(merged(ran.select("node")), "node", "left_semi")), "changed")
        parts = [changed]
        rounds.commit(facts, links=links, commands=ran, heads=tops, parts=parts, changed=changed)
    old, new = I.Interval(F.col("lo"), F.col("hi")), I.Interval(F.col("new_lo"), F.col("new_hi"))
    ops = known_ops(ran)

    def ended() -> None:
        if stop_after is not None and rounds.number > stop_after:
            raise RuntimeError(f"stopped after round {stop_after}")

    def state_of(tables: list[DataFrame]) -> DataFrame:
        state = tables[0]
        for t in tables[1:]:
            state = state.unionByName(t)
        return state if len(tables) == 1 else joined(state)

    while facts["phase"] == "widen":
        ended()
        if changed.isEmpty():
            state = rounds.cut(state_of(parts), "state")
            facts = {"phase": "narrow", "left": narrowing}
            rounds.commit(facts, links=links, commands=ran, heads=tops, parts=[state], changed=state)
            parts = [state]
            break
        state = state_of(parts)
        nodes = links.join(merged(changed.select(F.col("node").alias("src"), "loc")), ["src", "loc"], "left_semi").select(F.col("dst").alias("node")).distinct()
        inputs = rounds.cut(pulled(links, state, nodes), "inputs")  # each of `nodes` has some
        nodes = inputs.select("node").distinct()
        out = defined(ran, inputs, ops, nodes).select("node", "loc", F.col("lo").alias("new_lo"), F.col("hi").alias("new_hi"))
        both = out.join(merged(state.join(merged(nodes), "node", "left_semi")), ["node", "loc"], "left").join(merged(tops), "node", "left")
        more, wide = I.join(old, new), I.widen(old, I.join(old, new), steps)
        grown = I.Interval(F.when(F.col("head"), wide.lo).otherwise(more.lo), F.when(F.col("head"), wide.hi).otherwise(more.hi))
        changed = rounds.cut(both.where(~I.le(new, old)).select("node", "loc", *grown.alias()), "changed")
        parts = [*parts, changed]
        if len(parts) > COMPACT:
            parts = [rounds.cut(state_of(parts), "state")]
        rounds.commit(facts, links=links, commands=ran, heads=tops, parts=parts, changed=changed)
    state = parts[0]
    while facts["left"]:
        ended()
        out = defined(ran, rounds.cut(pulled(links, state), "inputs"), ops).select("node", "loc", F.col("lo").alias("new_lo"), F.col("hi").alias("new_hi"))
        less = I.narrow(old, I.meet(new, old), steps)
        rows = state.join(merged(out), ["node", "loc"], "left").select("node", "loc", *less.alias(), (~I.eq(less, old)).alias("shrank"))
        new_state = rounds.cut(rows, "state")
        facts = {"phase": "narrow", "left": facts["left"] - 1 if not new_state.where("shrank").isEmpty() else 0}
        state = new_state.where("lo is not null").drop("shrank")
        kept = rounds.cut(state, "state")
        rounds.commit(facts, links=links, commands=ran, heads=tops, parts=[kept], changed=kept)
        state = kept
    return state


def bounds_status(offset: I.Interval, size: I.Interval) -> Column:
    """Proven where all of `offset` lies within the smallest size, BotAlarm where either is bottom."""
    both = I.is_bottom(offset) | I.is_bottom(size)
    return F.when(both, "BotAlarm").when((offset.lo >= 0) & (offset.hi < size.lo), "Proven").otherwise("UnProven")


def bounds_alarms(checks: DataFrame, inputs: DataFrame) -> DataFrame:
    """`checks` (node, x_loc, y_loc, size_loc) with offset (x plus y, either may be null), size and status, from what reaches their nodes (`inputs`)."""
    rows = checks
    for side in ("x", "y", "size"):
        rows = rows.join(merged(inputs.select("node", F.col("loc").alias(f"{side}_loc"), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"))), ["node", f"{side}_loc"], "left")
    part = lambda s: I.Interval(*[F.when(F.col(f"{s}_loc").isNull(), F.lit(0).cast("long")).otherwise(F.col(f"{s}_{b}")) for b in ("lo", "hi")])
    offset, size = I.plus(part("x"), part("y")), I.interval("size_lo", "size_hi")
    return rows.select(*checks.columns, *offset.alias("off_lo", "off_hi"), "size_lo", "size_hi", bounds_status(offset, size).alias("status"))
