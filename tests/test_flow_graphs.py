"""Components, weak orders, dominators, frontiers, phi points and def-use edges against plain Python on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import components as comp
from factweave.operators import dominance as dom


def frame(spark, pairs, schema="src long, dst long"):
    return spark.createDataFrame(list(pairs), schema)


def reach(edges, start, without=None):
    seen, todo = set(), [start]
    while todo:
        n = todo.pop()
        if n not in seen and n != without:
            seen.add(n)
            todo += [d for s, d in edges if s == n]
    return seen


def random_graph(seed, n, more):
    """A graph with chains, joins, irreducible loops, loops to oneself and parts that nothing reaches."""
    r = random.Random(seed)
    edges = {(i, i + 1) for i in range(n - 1) if r.random() < 0.9}
    edges |= {(r.randrange(n), r.randrange(n)) for _ in range(more)}
    return edges


def plain_sccs(edges):
    nodes = {x for e in edges for x in e}
    to = {n: reach(edges, n) for n in nodes}
    return {n: min(m for m in to[n] if n in to[m]) for n in nodes}


@pytest.mark.parametrize(("seed", "n", "more"), [(1, 30, 12), (3, 12, 20)])
def test_strong_components(spark, seed, n, more):
    edges = random_graph(seed, n, more)
    assert dict(map(tuple, comp.strong_components(frame(spark, edges)).collect())) == plain_sccs(edges)


def test_long_cycles_and_edge_cases(spark):
    ring = spark.range(10_000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 10_000).alias("dst"))
    assert [tuple(r) for r in comp.strong_components(ring).groupBy("scc").count().collect()] == [(0, 10_000)]
    tail = frame(spark, [(i, i + 1) for i in range(200)] + [(150, 100), (7, 7), (300, 301), (301, 300), (400, 400)])
    got = dict(map(tuple, comp.strong_components(tail).collect()))
    assert got == {n: 100 if 100 <= n <= 150 else 300 if n == 301 else n for n in got} and set(got) == set(range(201)) | {300, 301, 400}
    assert comp.strong_components(frame(spark, [])).count() == 0
    assert {r.node for r in comp.cyclic_nodes(frame(spark, [(1, 1), (1, 2), (5, None), (None, 6)])).collect()} == {1}


def plain_wto(edges):
    """(heads, depth) by splitting components again and again."""
    depth, heads = {x: 0 for e in edges for x in e}, {s for s, d in edges if s == d}
    todo = [{(s, d) for s, d in edges if s != d}]
    while todo:
        now = todo.pop()
        of = plain_sccs(now) if now else {}
        for c in set(of.values()):
            inside = {n for n in of if of[n] == c}
            if len(inside) == 1:
                continue
            for n in inside:
                depth[n] += 1
            inner = {(s, d) for s, d in now if s in inside and d in inside}
            score = lambda n: sum(d == n for _, d in inner)
            entered = {d for s, d in now if d in inside and s not in inside}
            head = min(entered, key=lambda n: (-score(n), n)) if entered else min(inside)
            heads.add(head)
            todo.append({(s, d) for s, d in inner if d != head})
    return heads, depth


@pytest.mark.parametrize(("seed", "n", "more"), [(5, 20, 14)])
def test_weak_topological_order(spark, seed, n, more):
    edges = random_graph(seed, n, more)
    rows = comp.weak_topological_order(frame(spark, edges)).collect()
    heads, depth = plain_wto(edges)
    assert {r.node for r in rows if r.is_head} == heads and {r.node: r.depth for r in rows} == depth
    order = {r.node: r.order for r in rows}
    assert sorted(order.values()) == list(range(1, len(order) + 1))
    assert all(order[s] < order[d] or (d in heads and d in reach(edges, s) and s in reach(edges, d)) for s, d in edges)


def plain_idoms(edges, root):
    live = reach(edges, root)
    over = {d: live - reach(edges, root, d) for d in live}  # what d dominates
    strict = {n: {d for d in live if n in over[d] and d != n} for n in live}
    return {n: max(strict[n], key=lambda d: len(strict[d])) if strict[n] else None for n in live}, strict


def plain_frontiers(edges, root):
    idom, strict = plain_idoms(edges, root)
    return {(x, y) for x in idom for p, y in edges if p in idom and (x == p or x in strict[p]) and x not in strict[y]}


@pytest.mark.parametrize(("seed", "n", "more"), [(6, 25, 15), (7, 40, 10)])
def test_dominators_and_frontiers(spark, seed, n, more):
    edges = random_graph(seed, n, more)
    found = dom.dominance(frame(spark, edges), frame(spark, [(0,)], "node long"))
    assert dict(map(tuple, dom.immediate_dominators(found).collect())) == plain_idoms(edges, 0)[0]
    assert set(map(tuple, dom.frontiers(found).collect())) == plain_frontiers(edges, 0)


def plain_def_use(edges, root, defs, uses):
    """Phi points by iterated frontiers, then a walk over the dominator tree."""
    idom, _ = plain_idoms(edges, root)
    front, phis = plain_frontiers(edges, root), set()
    while True:
        more = {(y, v) for x, y in front for d, v in defs | phis if d == x} - phis
        if not more:
            break
        phis |= more
    out = set()

    def walk(node, held):
        out.update((held[v], node, v) for n, v in uses if n == node and (node, v) not in phis and v in held)
        held = held | {v: node for n, v in defs | phis if n == node}
        for succ in {d for s, d in edges if s == node}:
            out.update((held[v], succ, v) for n, v in phis if n == succ and v in held)
        for child in (n for n in idom if idom[n] == node):
            walk(child, held)

    walk(root, {})
    return phis, out


@pytest.mark.parametrize("seed", [9])
def test_phi_points_and_def_use(spark, seed):
    r = random.Random(seed)
    edges = random_graph(seed, 45, 16)
    live = reach(edges, 0)
    defs, uses = ({(r.randrange(45), v) for v in "abc" for _ in range(6)} for _ in range(2))
    found = dom.dominance(frame(spark, edges), frame(spark, [(0,)], "node long"))
    d, u = (frame(spark, rows, "node long, loc string") for rows in (defs, uses))
    phis, out = plain_def_use(edges, 0, {x for x in defs if x[0] in live}, uses)
    assert set(map(tuple, dom.phi_points(found, d).collect())) == phis
    assert set(map(tuple, dom.def_use(found, d, u).collect())) == out
