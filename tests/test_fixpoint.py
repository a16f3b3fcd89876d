"""Fixpoints of interval states by hand, and the further interval operators on edge cases."""

from factweave.functions import interval as I
from factweave.operators.fixpoint import fixpoint

FLOWS = "src string, dst string, add long, from long, to long"
START = "node string, lo long, hi long"


def solved(spark, flows, start, **options):
    got = fixpoint(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(start, START), **options)
    return {r.node: (r.lo, r.hi) for r in got.collect()}


def test_counting_loop_is_widened_and_narrowed(spark):
    """i = 0; while (i < 10) i++: the head holds [0, 10], the body [0, 9], the exit [10, 10]."""
    flows = [("in", "head", 0, I.NEG, I.POS), ("head", "body", 0, I.NEG, 9), ("body", "head", 1, I.NEG, I.POS), ("head", "exit", 0, 10, I.POS), (None, "head", 5, I.NEG, I.POS)]
    got = solved(spark, flows, [("in", 0, 0), ("bottom", 3, 2), (None, 0, 9)])
    assert got == {"in": (0, 0), "head": (0, 10), "body": (0, 9), "exit": (10, 10)}


def test_unbounded_loop_ends(spark):
    flows = [("x", "x", 1, I.NEG, I.POS), ("x", "y", 0, I.NEG, I.POS)]
    assert solved(spark, flows, [("x", 0, 0)]) == {"x": (0, I.POS), "y": (0, I.POS)}
    assert solved(spark, [], []) == {}


def test_further_interval_operators(spark):
    values = [(1, 3), (-4, 2), (None, None), (0, 0), (I.NEG, -3), (2, I.POS), (I.NEG, I.POS)]
    x = I.interval("lo", "hi")
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, lo long, hi long")
    columns = [*I.absolute(x).alias("a", "b"), I.height(x).alias("h"), I.spread_of(x).alias("s"), *I.logical_not(x).alias("c", "d"), *I.cast("int", "unsigned char", x).alias("e", "f")]
    got = [tuple(r) for r in rows.select("i", *columns).orderBy("i").drop("i").collect()]
    assert got == [
        (1, 3, 3, 2, 0, 0, 1, 3), (0, 4, 7, 6, 0, 1, -4, 2), (None, None, 0, 0, None, None, None, None), (0, 0, 1, 0, 1, 1, 0, 0),
        (3, I.POS, 1000, 0, 0, 0, I.NEG, -3), (2, I.POS, 1000, 0, 0, 0, I.NEG, I.POS), (0, I.POS, 1000, 0, 0, 1, I.NEG, I.POS),
    ]
