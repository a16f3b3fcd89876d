"""Sets that may be all but a few values, as rows: (key, elem), and a row with a null elem where the others are exceptions.

The top set is the marker row alone, the empty set no row. Every operation asks, for each listed value and once for all
that neither side lists, whether it is in one or both sets; so sets are never gathered and a large one is many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(x: DataFrame, y: DataFrame) -> DataFrame:
    """(key, elem, in_x, in_y, all_x, all_y): whether both sets hold each listed value, and values that neither lists. Null keys are none."""
    rows = x.select("key", "elem", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(y.select("key", "elem", F.lit(0).alias("x"), F.lit(1).alias("y"))).where("key is not null")
    seen = rows.groupBy("key", "elem").agg((F.max("x") == 1).alias("x"), (F.max("y") == 1).alias("y"))
    marks = seen.where("elem is null").select("key", F.col("x").alias("all_x"), F.col("y").alias("all_y"))
    both = seen.join(marks, "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("all_x", "all_y")})
    listed = F.col("elem").isNotNull()
    # A listed value is in a set of few, and out of a set of all but some.
    return both.select("key", "elem", *[F.when(listed, F.col(s) != F.col(f"all_{s}")).otherwise(F.col(f"all_{s}")).alias(f"in_{s}") for s in "xy"], "all_x", "all_y")


def combined(x: DataFrame, y: DataFrame, op: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, elem): the values for which `op` holds of being in x and in y; it must not hold of being in neither."""
    rows = _sides(x, y).withColumns({"here": op(F.col("in_x"), F.col("in_y")), "rest": op(F.col("all_x"), F.col("all_y"))})
    return rows.where(F.when(F.col("elem").isNull(), F.col("here")).otherwise(F.col("here") != F.col("rest"))).select("key", "elem")


def join(x: DataFrame, y: DataFrame) -> DataFrame:
    """Union; also the widening, as chains of such sets over what a program lists end."""
    return combined(x, y, lambda a, b: a | b)


def meet(x: DataFrame, y: DataFrame) -> DataFrame:
    return combined(x, y, lambda a, b: a & b)


def le(x: DataFrame, y: DataFrame) -> DataFrame:
    """(key, is_le) of the keys that either side has rows of."""
    return _sides(x, y).groupBy("key").agg((~F.bool_or((F.col("in_x") & ~F.col("in_y")) | (F.col("all_x") & ~F.col("all_y")))).alias("is_le"))
