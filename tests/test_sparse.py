"""Programs typed by hand: their def-use graphs, fixpoints, alarms and counters; runs that are ended and resumed."""

import pytest

from factweave.functions import interval as I
from factweave.operators import components as comp
from factweave.operators import dominance as dom
from factweave.operators import sparse
from factweave.operators.rounds import Rounds

INF = (I.NEG, I.POS)


def program(spark, cfg, nodes):
    """Flow edges, defs, uses and commands of {name: (defs, uses, [command])}; a command is (loc, op, x, y, weak), operands a location or bounds."""
    number = {n: i for i, n in enumerate(nodes)}
    operand = lambda v: (v, None, None) if isinstance(v, str) else (None, *(v or (None, None)))
    rows = [(number[n], loc, op, *operand(x), *operand(y), weak) for n, (_, _, cs) in nodes.items() for loc, op, x, y, weak in cs]
    defs, uses = ([(number[n], v) for n, at in nodes.items() for v in at[k].split()] for k in (0, 1))
    frame = lambda r, s: spark.createDataFrame(r, s)
    edges = frame([(number[a], number[b]) for line in cfg for a, b in zip(line.split(), line.split()[1:])], "src long, dst long")
    return number, edges, frame(defs, "node long, loc string"), frame(uses, "node long, loc string"), frame(rows, sparse.COMMANDS)


#: char arr[10] and a block of 20 bytes, both indexed by i from 0 while i < 20. `s` and `m` are what the blocks hold, `a.` the parts of a pointer.
TEST = {
    "ENTRY": ("", "", []), "A1": ("tmp", "", []), "A2": ("arr", "tmp", []), "M1": ("tmp2", "", []), "M2": ("p", "tmp2", []), "I0": ("i", "", [("i", "copy", (0, 0), None, False)]),
    "LH": ("", "", []), "IF": ("", "", []), "T": ("i", "i", [("i", "lt", "i", (20, 20), False)]), "F": ("i", "i", [("i", "ge", "i", (20, 20), False)]),
    "B1": ("s", "arr i s", []), "B2": ("m", "p i m", []), "B3": ("i", "i", [("i", "plus", "i", (1, 1), False)]), "R": ("ret", "", []), "EXIT": ("", "", []),
}
TEST_CFG = ["ENTRY A1 A2 M1 M2 I0 LH IF T B1 B2 B3 LH", "IF F R EXIT"]
TEST_DUG = "A1-A2:tmp M1-M2:tmp2 I0-LH:i B3-LH:i B1-LH:s B2-LH:m LH-T:i LH-F:i T-B1:i A2-B1:arr LH-B1:s T-B2:i M2-B2:p LH-B2:m T-B3:i"

NARROW = {
    "ENTRY": ("", "", []), "A1": ("tmp", "", []), "A2": ("arr", "tmp", []), "I0": ("i", "", [("i", "copy", (0, 0), None, False)]), "LH1": ("", "", []), "IF1": ("", "", []),
    "T1": ("i", "i", [("i", "lt", "i", (9, 9), False)]), "F1": ("i", "i", [("i", "ge", "i", (9, 9), False)]), "B1": ("s", "arr i s", []), "C1": ("i", "i", [("i", "plus", "i", (1, 1), False)]), "D": ("s", "arr i s", []),
    "E": ("i", "", [("i", "copy", (0, 0), None, False)]), "LH2": ("", "", []), "CALL": ("tmp2", "", [("tmp2", "copy", INF, None, False)]), "RET": ("tmp2", "tmp2", []), "IF2": ("", "", []),
    "T2": ("i", "i tmp2", [("i", "lt", "i", "tmp2", False)]), "F2": ("i", "i tmp2", [("i", "ge", "i", "tmp2", False)]), "B2": ("s", "arr i s", []), "C2": ("i", "i", [("i", "plus", "i", (1, 1), False)]), "R": ("ret", "", []), "EXIT": ("", "", []),
}
NARROW_CFG = ["ENTRY A1 A2 I0 LH1 IF1 T1 B1 C1 LH1", "IF1 F1 D E LH2 CALL RET IF2 T2 B2 C2 LH2", "IF2 F2 R EXIT"]
NARROW_DUG = """A1-A2:tmp I0-LH1:i C1-LH1:i B1-LH1:s LH1-T1:i LH1-F1:i T1-B1:i A2-B1:arr LH1-B1:s T1-C1:i F1-D:i A2-D:arr LH1-D:s
 E-LH2:i D-LH2:s C2-LH2:i B2-LH2:s RET-LH2:tmp2 CALL-RET:tmp2 LH2-T2:i RET-T2:tmp2 LH2-F2:i RET-F2:tmp2 T2-B2:i A2-B2:arr LH2-B2:s T2-C2:i"""


def graph_of(spark, cfg, nodes):
    number, edges, defs, uses, commands = program(spark, cfg, nodes)
    found = dom.dominance(edges, spark.createDataFrame([(number["ENTRY"],)], "node long"))
    return number, dom.def_use(found, defs, uses), commands


@pytest.mark.parametrize(("cfg", "nodes", "wanted", "n_nodes", "n_locs"), [(TEST_CFG, TEST, TEST_DUG, 11, 15), (NARROW_CFG, NARROW, NARROW_DUG, 17, 27)])
def test_def_use_graphs(spark, cfg, nodes, wanted, n_nodes, n_locs):
    """With the edge from the start to the call of main, which has one location, these are the published counts of nodes less 2 and locations less 1."""
    number, dug, _ = graph_of(spark, cfg, nodes)
    name = {i: n for n, i in number.items()}
    got = [(name[r.src], name[r.dst], r["loc"]) for r in dug.collect()]
    assert sorted(f"{a}-{b}:{v}" for a, b, v in got) == sorted(wanted.split())
    assert {name[r.node] for r in comp.loop_heads(dug).collect()} == {n for n in nodes if n.startswith("LH")}
    assert len({n for a, b, _ in got for n in (a, b)}) == n_nodes and len(got) == n_locs


def solved(spark, cfg, nodes, wanted, heads, thresholds, **options):
    """From the def-use edges that test_def_use_graphs finds; both pointers have offset 0, sizes are constants of the program."""
    number, _, _, _, commands = program(spark, cfg, nodes)
    edges = [(number[ab.split("-")[0]], number[ab.split("-")[1]], loc) for ab, loc in (e.split(":") for e in wanted.split())]
    dug = spark.createDataFrame(edges, "src long, dst long, loc string")
    state = sparse.sparse_fixpoint(dug, commands, spark.createDataFrame([(number[h],) for h in heads], "node long"), thresholds, **options)
    name = {i: n for n, i in number.items()}
    inputs = sparse.pulled(dug, state)
    return number, inputs, {(name[r.node], r["loc"]): (r.lo, r.hi) for r in state.collect()}


def alarms(spark, number, inputs, checks):
    sized = inputs.unionByName(spark.createDataFrame([(number[n], "size", size, size) for n, size in checks.items()], "node long, loc string, lo long, hi long"))
    rows = spark.createDataFrame([(number[n], "i", None, "size") for n in checks], "node long, x_loc string, y_loc string, size_loc string")
    name = {i: n for n, i in number.items()}
    return {name[r.node]: (r.off_lo, r.off_hi, r.size_lo, r.status) for r in sparse.bounds_alarms(rows, inputs=sized).collect()}


def test_alarms_of_a_loop(spark):
    number, inputs, state = solved(spark, TEST_CFG, TEST, TEST_DUG, ["LH"], [64], narrowing=0)
    assert state["LH", "i"] == (0, 64) and state["T", "i"] == (0, 19) and state["F", "i"] == (20, 64)
    assert alarms(spark, number, inputs, {"B1": 10, "B2": 20}) == {"B1": (0, 19, 10, "UnProven"), "B2": (0, 19, 20, "Proven")}


def test_narrowing_proves_an_index_after_a_loop(spark):
    checks = {"B1": 10, "D": 10, "B2": 10}
    number, inputs, state = solved(spark, NARROW_CFG, NARROW, NARROW_DUG, ["LH1", "LH2"], [16])
    assert state["F1", "i"] == (9, 9)  # 16 before narrowing
    assert alarms(spark, number, inputs, checks) == {"B1": (0, 8, 10, "Proven"), "D": (9, 9, 10, "Proven"), "B2": (0, I.POS, 10, "UnProven")}


def test_weak_and_several_commands_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (None, 3, "x"), (3, None, "x"), (3, 4, None)], "src long, dst long, loc string")
    rows = [(1, "x", "copy", None, 5, 5, None, None, None, None), (2, "x", "copy", None, 9, 9, None, None, None, True), (3, "y", "times", "x", None, None, None, 2, 2, False), (3, "y", "copy", None, -1, -1, None, None, None, False),
            (4, "z", "copy", "absent", None, None, None, None, None, False), (None, "x", "copy", None, 0, 0, None, None, None, False), (5, "w", "strange", None, 1, 1, None, None, None, False)]
    got = sparse.sparse_fixpoint(edges, spark.createDataFrame(rows, sparse.COMMANDS), spark.createDataFrame([], "node long"))
    assert {(r.node, r["loc"]): (r.lo, r.hi) for r in got.collect()} == {(1, "x"): (5, 5), (2, "x"): (5, 9), (3, "x"): (5, 9), (3, "y"): (-1, 18), (5, "w"): INF}
    none = spark.createDataFrame([], sparse.COMMANDS)
    assert sparse.sparse_fixpoint(edges, none, spark.createDataFrame([], "node long")).count() == 0


def test_a_run_that_was_ended_goes_on(spark, tmp_path):
    """A loop ended in round 3 and again in a later one ends with the rows of a run at once, and does no round twice."""
    edges = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 2, "x"), (2, 4, "x")], "src long, dst long, loc string")
    rows = [(1, "x", "copy", None, 0, 0, None, None, None, False), (3, "x", "plus", "x", None, None, None, 1, 1, False), (4, "x", "lt", "x", None, None, None, 40, 40, False)]
    commands, heads = spark.createDataFrame(rows, sparse.COMMANDS), spark.createDataFrame([(2,)], "node long")
    once = sorted(map(tuple, sparse.sparse_fixpoint(edges, commands, heads, [64]).collect()))
    home = str(tmp_path / "run")
    for stop in (3, 5):
        with pytest.raises(RuntimeError, match="stopped"):
            sparse.sparse_fixpoint(edges, commands, heads, [64], home=home, stop_after=stop)
    done = {p.name for p in (tmp_path / "run" / "manifests").iterdir()}
    broken = spark.createDataFrame([], sparse.COMMANDS)  # what a resumed run reads is its own copy
    assert sorted(map(tuple, sparse.sparse_fixpoint(edges, broken, heads, [64], home=home).collect())) == once
    after = sorted(p.name for p in (tmp_path / "run" / "manifests").iterdir())
    assert done < set(after) and len({n.split("-")[0] for n in after}) == len(after)
    assert len(list((tmp_path / "run" / "tables").iterdir())) <= 6  # replaced rounds are gone


def test_no_round_gathers_a_table_in_the_driver(spark, monkeypatch):
    """Written tables look as small as their files, so Spark would broadcast those of millions of rows."""
    plans, cut = [], Rounds.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Rounds, "cut", lambda self, df, label: [plans.append((label, plan(df))), cut(self, df, label)][1])
    edges = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 2, "x"), (2, 4, "x"), (4, 5, "x"), (5, 2, "x")], "src long, dst long, loc string")
    rows = [(1, "x", "copy", None, 0, 0, None, None, None, False), (3, "x", "plus", "x", None, None, None, 1, 1, False), (4, "x", "lt", "x", None, None, None, 40, 40, False), (5, "x", "copy", "x", None, None, None, None, None, True)]
    heads = comp.loop_heads(edges)
    assert [r.node for r in heads.collect()] == [2]
    state = sparse.sparse_fixpoint(edges, spark.createDataFrame(rows, sparse.COMMANDS), heads, narrowing=1)
    inputs = sparse.pulled(edges, state)
    checks = spark.createDataFrame([(3, "x", None, "x")], "node long, x_loc string, y_loc string, size_loc string")
    plans.append(("alarms", plan(sparse.bounds_alarms(checks, inputs))))
    assert {(r.node, r.lo, r.hi) for r in state.collect()} == {(1, 0, 0), (2, 0, I.POS), (3, 1, I.POS), (4, 0, 39), (5, 0, 39)}
    assert {"chains", "labels", "back", "changed", "inputs", "state"} <= {label for label, _ in plans}
    assert [label for label, text in plans if "Broadcast" in text] == []
