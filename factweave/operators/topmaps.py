"""Maps of intervals that may be the top map, as rows: (key, loc, lo, hi), and a row with a null loc where the map is top.

The empty map has no row; a location without a row is bottom. A top map says nothing of single locations, so its other
rows don't count. Rows of equal key and location count as their join, rows of bottom as none, rows of a null key are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import interval as I
from factweave.functions.interval import Interval

def _xy() -> tuple[Interval, Interval]:
    return Interval(F.col("a"), F.col("b")), Interval(F.col("c"), F.col("d"))


def _sides(x: DataFrame, y: DataFrame) -> DataFrame:
    """(key, loc, a, b, c, d, top_x, top_y): both maps' intervals at each location, and, at a null loc, one row for each key.

    Both maps are combined in one aggregation; markers, a row a key, are what is joined.
    """
    value = I.interval("lo", "hi")
    side = lambda m, name: m.where("key is not null").select("key", "loc", *value.alias(), F.lit(name).alias("side"))
    rows = side(x, "x").unionByName(side(y, "y"))
    of = lambda name, c: F.when(F.col("side") == name, F.col(c))
    held = rows.groupBy("key", "loc").agg(
        F.min(of("x", "lo")).alias("a"), F.max(of("x", "hi")).alias("b"), F.min(of("y", "lo")).alias("c"), F.max(of("y", "hi")).alias("d"),
        F.bool_or((F.col("side") == "x") & F.col("loc").isNull()).alias("m_x"), F.bool_or((F.col("side") == "y") & F.col("loc").isNull()).alias("m_y"),
    )
    marks = held.groupBy("key").agg(F.bool_or("m_x").alias("top_x"), F.bool_or("m_y").alias("top_y"))
    listed = held.where("loc is not null").join(marks, "key").drop("m_x", "m_y")
    none = [F.lit(None).cast("long").alias(c) for c in "abcd"]
    whole = marks.select("key", F.lit(None).cast(held.schema["loc"].dataType).alias("loc"), *none, "top_x", "top_y")
    return listed.unionByName(whole)


def _combined(x: DataFrame, y: DataFrame, top: Column, value: Interval) -> DataFrame:
    """(key, loc, lo, hi): the marker where `top` holds of both markers, else `value` of both intervals where it isn't bottom."""
    rows = _sides(x, y).withColumn("top", top)
    rows = rows.select("key", "loc", "top", *[F.when(F.col("loc").isNotNull(), c).alias(n) for c, n in zip((value.lo, value.hi), ("lo", "hi"))])
    return rows.where(F.when(F.col("top"), F.col("loc").isNull()).otherwise(F.col("lo").isNotNull())).drop("top")


def _chosen(both: Interval) -> Interval:
    """x where y's map is top, y where x's is, else `both`."""
    (x, y), only_x, only_y = _xy(), F.col("top_y"), F.col("top_x")
    pick = lambda b, p, q: F.when(only_x, p).when(only_y, q).otherwise(b)
    return Interval(pick(both.lo, x.lo, y.lo), pick(both.hi, x.hi, y.hi))


def join(x: DataFrame, y: DataFrame) -> DataFrame:
    return _combined(x, y, F.col("top_x") | F.col("top_y"), I.join(*_xy()))


def meet(x: DataFrame, y: DataFrame) -> DataFrame:
    """The other map where one is top; locations whose meet is empty have no row."""
    return _combined(x, y, F.col("top_x") & F.col("top_y"), _chosen(I.meet(*_xy())))


def widen(x: DataFrame, y: DataFrame, thresholds: list[int]) -> DataFrame:
    """x widened by y, location by location; top where either is."""
    return _combined(x, y, F.col("top_x") | F.col("top_y"), I.widen(*_xy(), thresholds))


def narrow(x: DataFrame, y: DataFrame) -> DataFrame:
    """The other map where one is top, else the infinite bounds of x as y, which must be smaller, has them."""
    return _combined(x, y, F.col("top_x") & F.col("top_y"), _chosen(I.narrow(*_xy())))


def le(x: DataFrame, y: DataFrame) -> DataFrame:
    """(key, is_le) of the keys that either side has rows of: all lies in top, and top in nothing else."""
    rows = _sides(x, y)
    held = F.when(F.col("top_y"), True).when(F.col("top_x"), False).when(F.col("loc").isNull(), True).otherwise(I.le(*_xy()))
    return rows.groupBy("key").agg(F.bool_and(held).alias("is_le"))


def eq(x: DataFrame, y: DataFrame) -> DataFrame:
    """(key, is_eq) of the keys that either side has rows of."""
    rows = _sides(x, y)
    held = F.when(F.col("top_x") | F.col("top_y"), F.col("top_x") & F.col("top_y")).when(F.col("loc").isNull(), True).otherwise(I.eq(*_xy()))
    return rows.groupBy("key").agg(F.bool_and(held).alias("is_eq"))


def _added(m: DataFrame, bindings: DataFrame, combine: Callable[[Interval, Interval], Interval]) -> DataFrame:
    """Bindings (key, loc, lo, hi) never make a map top, and never unmake it; those of a null location are left out."""
    at = F.col("c").isNotNull()
    (x, y), both = _xy(), combine(*_xy())
    value = Interval(F.when(at, both.lo).otherwise(x.lo), F.when(at, both.hi).otherwise(x.hi))
    return _combined(m, bindings.where("loc is not null"), F.col("top_x"), value)


def add(m: DataFrame, bindings: DataFrame) -> DataFrame:
    """`bindings` replace what the map holds there; one of bottom changes nothing."""
    return _added(m, bindings, lambda x, y: y)


def weak_add(m: DataFrame, bindings: DataFrame) -> DataFrame:
    return _added(m, bindings, I.join)


def widen_add(m: DataFrame, bindings: DataFrame, thresholds: list[int]) -> DataFrame:
    return _added(m, bindings, lambda x, y: I.widen(x, y, thresholds))
