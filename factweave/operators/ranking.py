"""Ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.graph import cut


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` and rank (from 1) in `order`, which should end in a key so that ties spread and ranks are the same on every run.

    Rows are dealt by ranges of `order` and numbered within a range; a range starts where the counts before it end.
    The counts are a row a range, so they are broadcast.
    """
    ranges = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__nth", nth).join(F.broadcast(starts), "__range").withColumn("rank", (F.col("__start") + F.col("__nth")).cast("long")).drop("__range", "__nth", "__start")


def take_top(rows: DataFrame, order: list[Column], percent: int) -> DataFrame:
    """The first `percent` of all rows, rounded down."""
    all_of = ranked(rows, order)
    return all_of.where(F.col("rank") <= all_of.count() * percent // 100)
