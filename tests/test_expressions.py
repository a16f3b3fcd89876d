"""Nested sets of random trees, checks and filters against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import alarm_queries as Q
from factweave.operators import expressions as E

OPS = ["var", "const", "plus", "minus", "plus_ptr", "mem", "index", "field", "cast", "sizeof", "and", "div", "times"]
SCHEMA = "tree long, node long, parent long, pos int, op string, name string, is_global boolean, is_int boolean, to_union boolean"


class Node:
    def __init__(self, tree, number, op, rng):
        self.tree, self.number, self.op, self.children = tree, number, op, []
        self.flags = tuple(rng.random() < 0.3 for _ in range(3))

    def all(self):
        yield self
        for c in self.children:
            yield from c.all()


def random_trees(n=60, deep=40):
    rng, roots, rows = random.Random(5), [], []
    for tree in range(n):
        size = deep if tree == 0 else rng.randrange(1, 25)
        nodes = [Node(tree, 100 * tree + i * 7 % 101, rng.choice(OPS), rng) for i in range(size)]
        for i, node in enumerate(nodes):
            up = None
            if i:
                up = nodes[i - 1] if tree == 0 else rng.choice([m for m in nodes[:i] if len(m.children) < 2])
                up.children.append(node)
            rows.append((tree, node.number, up.number if up else None, len(up.children) - 1 if up else 0, node.op, "x", *node.flags))
        roots.append(nodes[0])
    rng.shuffle(rows)
    return roots, rows


def seen(node):
    yield node
    if node.op != "sizeof":
        for c in node.children:
            yield from seen(c)


def odd(node):
    is_global, is_int, to_union = node.flags
    ops = [c.op for c in node.children]
    if node.op in ("index", "mem", "and") or (node.op == "var" and (to_union or (is_global and is_int))):
        return True
    if node.op == "plus_ptr" and ops[:1] and ops[0] in ("mem", "field"):
        return True
    if node.op in ("plus", "minus") and len(ops) == 2 and set(ops) <= {"var", "index"}:
        return True
    return node.op in ("cast", *Q.BINARY) and any(odd(c) for c in node.children)


@pytest.fixture(scope="module")
def trees(spark):
    roots, rows = random_trees()
    return roots, E.nested(spark.createDataFrame(rows, SCHEMA)).cache()


def test_numbers(trees):
    roots, nodes = trees
    wanted = set()
    for root in roots:
        order = list(root.all())
        wanted |= {(n.tree, n.number, i, i + len(list(n.all())) - 1) for i, n in enumerate(order, 1)}
    assert {(r.tree, r.node, r.pre, r["last"]) for r in nodes.collect()} == wanted


def checked(roots):
    kinds = {"index": "array", "mem": "deref", "field": "deref", "div": "div"}
    for root in roots:
        for n in seen(root):
            at = 1 if n.op == "div" else 0
            if n.op in kinds and len(n.children) > at:
                yield n, kinds[n.op], n.children[at]


def test_checks_and_trust(spark, trees):
    roots, nodes = trees
    calls = spark.createDataFrame([(3, "strcpy"), (4, "free"), (5, None)], "tree long, callee string")
    found = Q.collect(nodes, calls)
    wanted = {(n.tree, n.number, kind, sub.number) for n, kind, sub in checked(roots)} | {(3, roots[3].number, "strcpy", None)}
    assert {(r.tree, r.node, r.kind, r.sub) for r in found.collect()} == wanted
    kept = {(n.tree, n.number) for n, kind, sub in checked(roots) if kind == "div" or not odd(sub)} | {(3, roots[3].number)}
    assert {(r.tree, r.node) for r in Q.trusted(found, nodes).collect()} == kept
    assert 1 < len(kept) < len(wanted)


def test_many_unproven_checks_of_a_point_count_as_proven(spark):
    rows = spark.createDataFrame([(t, i, "UnProven") for t in (3, 4) for i in range(t)] + [(4, 9, "BotAlarm"), (3, 9, "Proven")], "tree long, node long, status string")
    got = {(r.tree, r.node): r.status for r in Q.calmed(rows, ["tree"]).collect()}
    assert got == {**{(3, i): "UnProven" for i in range(3)}, **{(4, i): "Proven" for i in (0, 1, 2, 3, 9)}, (3, 9): "Proven"}


def test_missing_parents_and_cycles(spark):
    lost = spark.createDataFrame([(1, 1, None, 0), (1, 2, 9, 0), (2, 1, None, 0)], "tree long, node long, parent long, pos int")
    assert {(r.tree, r.node) for r in E.paths(lost).collect()} == {(1, 1), (2, 1)}
    assert E.nested(lost.where(F.lit(False))).count() == 0
    with pytest.raises(RuntimeError, match="cycles"):
        E.paths(spark.createDataFrame([(1, 1, 2, 0), (1, 2, 1, 0)], "tree long, node long, parent long, pos int")).count()
