"""Sets with a top against sets of a small universe, one value of which stands for all that is never listed."""

from itertools import product

from pyspark.sql import functions as F

from factweave.operators import cosets

UNIVERSE, REST = {1, 2, 3, 99}, 99
FORMS = [(full, frozenset(listed)) for full in (False, True) for listed in ((), (1,), (1, 2), (2, 3))]


def values(form):
    full, listed = form
    return UNIVERSE - listed if full else set(listed)


def test_against_python_sets(spark):
    pairs = dict(enumerate(product(FORMS, FORMS)))
    rows = [[(k, e) for k, p in pairs.items() for e in [*p[side][1], *([None] if p[side][0] else [])]] for side in (0, 1)]
    x, y = (spark.createDataFrame(r + r[:5] + [(None, 1)], "key long, elem int") for r in rows)  # repeated rows and a null key
    for op, want in ((cosets.join, set.union), (cosets.meet, set.intersection), (lambda a, b: cosets.combined(a, b, lambda p, q: p & ~q), set.difference)):
        got = {k: set() for k in pairs}
        full = {}
        for r in op(x, y).collect():
            full[r.key] = full.get(r.key, False) or r.elem is None
            got[r.key] |= set() if r.elem is None else {r.elem}
        assert {k: values((full.get(k, False), frozenset(v))) for k, v in got.items()} == {k: want(values(a), values(b)) for k, (a, b) in pairs.items()}
    there = {k for k, (a, b) in pairs.items() if a != (False, frozenset()) or b != (False, frozenset())}
    assert {r.key: r.is_le for r in cosets.le(x, y).collect()} == {k: values(pairs[k][0]) <= values(pairs[k][1]) for k in there}
    assert cosets.join(x.where(F.lit(False)), y.where(F.lit(False))).count() == 0
