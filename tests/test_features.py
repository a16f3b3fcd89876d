"""Features of hand-written commands, closures over copies, and scores against plain Python."""

import random

from pyspark.sql import functions as F

from factweave.operators import expressions as E
from factweave.operators import features as W


def expr(tree, *nodes):
    """Rows of a tree from (parent, pos, op, name, value) of its nodes."""
    return [(tree, i, p, pos, op, name, value) for i, (p, pos, op, name, value) in enumerate(nodes, 1)]


def test_commands(spark):
    rows = [
        *expr(1, (None, 0, "plus", None, None), (1, 0, "var", "x", None), (1, 1, "const", None, 1)),  # x = x + 1, in a loop
        *expr(2, (None, 0, "lt", None, None), (1, 0, "var", "x", None), (1, 1, "sizeof", None, None), (3, 0, "var", "hidden", None)),  # x < sizeof(hidden)
        *expr(3, (None, 0, "cast", None, None), (1, 0, "var", "y", None)),  # z = (t) y
        *expr(4, (None, 0, "var", "z", None)),  # p = alloc(z)
        *expr(5, (None, 0, "mem", None, None), (1, 0, "plus_ptr", None, None), (2, 0, "var", "p", None), (2, 1, "var", "i", None)),  # q = *(p + i), in a recursive procedure
        *expr(6, (None, 0, "not", None, None), (1, 0, "var", "q", None)),  # !q
        *expr(7, (None, 0, "var", "z", None)),  # r = realloc(z)
    ]
    nodes = E.nested(spark.createDataFrame(rows, "tree long, node long, parent long, pos int, op string, name string, value long"))
    made = [(1, 1, "set", "x", None, True), (2, 1, "assume", None, None, False), (3, 1, "set", "z", None, False), (4, 1, "alloc", "p", None, False), (5, 2, "set", "q", None, False), (6, 2, "assume", None, None, False), (7, 2, "call", "r", "realloc", False)]
    commands = spark.createDataFrame(made, "tree long, proc long, kind string, target string, callee string, in_loop boolean")
    found = W.commands_features(nodes, commands, spark.createDataFrame([(2,)], "proc long"))
    wanted = {
        ("x", "inc_itself_by_one"), ("x", "inc"), ("x", "mod_inside_loops"), ("x", "used_inside_loops"), ("x", "prune_by_const"), ("z", "pass_to_alloc"), ("p", "return_from_alloc"),
        ("p", "used_as_array_buf"), ("i", "used_as_array_index"), ("q", "mod_in_rec_fun"), ("q", "prune_by_not"), ("z", "pass_to_realloc"), ("r", "return_from_realloc"),
    }
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    copied = W.copies(nodes, commands)
    assert {tuple(r) for r in copied.collect()} == {("y", "z")}
    assert {tuple(r) for r in W.closures(found, copied).collect()} == {("y", "pass_to_alloc_clos"), ("y", "pass_to_realloc_clos")}


def test_closures_go_round_cycles_and_both_ways(spark):
    copied = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    found = spark.createDataFrame([("d", "pass_to_alloc"), ("b", "return_from_alloc"), ("a", "inc")], "loc string, feature string")
    assert {tuple(r) for r in W.closures(found, copied).collect()} == {*((x, "pass_to_alloc_clos") for x in "abc"), *((x, "return_from_alloc_clos") for x in "acde")}


def test_scores(spark):
    rng, weights = random.Random(3), [2.0**-n for n in range(45)]
    has = {f"l{i}": {f for f in (*W.ATOMIC, "inc") if rng.random() < 0.3} for i in range(60)} | {"none": set()}
    rows = spark.createDataFrame([(x, f) for x, fs in has.items() for f in fs], "loc string, feature string")
    locations = spark.createDataFrame([(x,) for x in has], "loc string")

    def score(fs):
        rules = [all(fs & set(g) for g in groups) and not fs & set(never) for groups, never in W.RULES]
        return sum(w for w, met in zip(weights, [*(f in fs for f in W.ATOMIC), *rules]) if met)

    got = {r.loc: r.weight for r in W.scores(locations, rows, weights).collect()}
    assert got == {x: score(fs) for x, fs in has.items()} and len(W.ATOMIC) + len(W.RULES) == 45
    assert {r.weight for r in W.scores(locations, rows, []).collect()} == {0.0}
    assert W.scores(locations.where(F.lit(False)), rows.where(F.lit(False)), weights).count() == 0
