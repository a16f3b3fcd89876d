"""Maps with a top against plain Python dictionaries."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from factweave.functions import interval as I
from factweave.operators import topmaps

TOP = "top"
FORMS = [TOP, {}, {1: (0, 5)}, {1: (2, 9), 2: (3, 3)}, {2: (0, 4), 3: (I.NEG, I.POS)}]


def frames(spark, pairs):
    made = []
    for side in (0, 1):
        rows = [(k, None, None, None) if p[side] is TOP else (k, loc, *v) for k, p in pairs.items() for loc, v in ([(0, 0)] if p[side] is TOP else p[side].items())]
        # repeated rows, a null key, a bottom, and a row of a top map, which says nothing
        more = [(None, 1, 0, 0), (0, 3, 5, 2), *[(k, 7, 1, 1) for k, p in pairs.items() if p[side] is TOP]]
        made.append(spark.createDataFrame(rows + rows[:4] + more, "key long, loc int, lo long, hi long"))
    return made


def collected(df, keys):
    got = {k: {} for k in keys}
    for r in df.collect():
        if r.loc is None:
            assert got[r.key] == {}
            got[r.key] = TOP
        else:
            got[r.key][r.loc] = (r.lo, r.hi)
    return got


def join(x, y):
    return TOP if TOP in (x, y) else {k: (min(a[0] for a in (x.get(k), y.get(k)) if a), max(a[1] for a in (x.get(k), y.get(k)) if a)) for k in x.keys() | y.keys()}


def meet(x, y):
    if TOP in (x, y):
        return y if x is TOP else x
    both = {k: (max(x[k][0], y[k][0]), min(x[k][1], y[k][1])) for k in x.keys() & y.keys()}
    return {k: v for k, v in both.items() if v[0] <= v[1]}


def le(x, y):
    return y is TOP or (x is not TOP and all(k in y and y[k][0] <= a and b <= y[k][1] for k, (a, b) in x.items()))


def widen(x, y):
    if TOP in (x, y):
        return TOP
    one = lambda a, b: a if b is None else b if a is None else (a[0] if b[0] >= a[0] else I.NEG, a[1] if b[1] <= a[1] else I.POS)
    return {k: one(x.get(k), y.get(k)) for k in x.keys() | y.keys()}


@pytest.mark.parametrize("op,model", [(topmaps.join, join), (topmaps.meet, meet), (lambda x, y: topmaps.widen(x, y, []), widen), (topmaps.add, lambda x, y: x if y is TOP else TOP if x is TOP else x | y),
                                      (topmaps.weak_add, lambda x, y: x if y is TOP else TOP if x is TOP else join(x, y))], ids=["join", "meet", "widen", "add", "weak_add"])
def test_against_dictionaries(spark, op, model):
    pairs = dict(enumerate(product(FORMS, FORMS)))
    x, y = frames(spark, pairs)
    if op in (topmaps.add, topmaps.weak_add):  # bindings have no top
        pairs = {k: p for k, p in pairs.items() if p[1] is not TOP}
        x, y = frames(spark, pairs)
    assert collected(op(x, y), pairs) == {k: model(*p) for k, p in pairs.items()}


def test_orders(spark):
    pairs = dict(enumerate(product(FORMS, FORMS)))
    x, y = frames(spark, pairs)
    held = {r.key: r.is_le for r in topmaps.le(x, y).collect()}
    assert held == {k: le(*p) for k, p in pairs.items() if k in held} and len(held) == 24
    assert {r.key: r.is_eq for r in topmaps.eq(x, y).collect()} == {k: p[0] == p[1] for k, p in pairs.items() if k in held}


def test_narrowing(spark):
    pairs = {0: ({1: (I.NEG, 9)}, {1: (2, 7)}), 1: (TOP, {1: (2, 7)}), 2: ({1: (2, 7)}, TOP), 3: (TOP, TOP), 4: ({1: (0, 3)}, {})}
    assert collected(topmaps.narrow(*frames(spark, pairs)), pairs) == {0: {1: (2, 9)}, 1: {1: (2, 7)}, 2: {1: (2, 7)}, 3: TOP, 4: {}}


def test_empty(spark):
    x, y = (df.where(F.lit(False)) for df in frames(spark, {0: ({}, {})}))
    assert topmaps.join(x, y).count() == topmaps.le(x, y).count() == 0
