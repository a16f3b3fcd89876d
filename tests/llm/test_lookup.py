"""Lookups with a table too large for a broadcast."""

import pytest
from pyspark.sql import functions as F

from factweave.llm.common import lookup


@pytest.mark.parametrize("how", ["left", "inner"])
def test_copies_of_a_large_table_are_not_broadcast(spark, how):
    """Spark takes the salted copies for as small as the table, so it would broadcast 32 times what it means to."""
    big = spark.range(0, 600, 1, 4).select(F.when(F.col("id") % 7 > 0, F.col("id") % 300).alias("k"), "id")
    small = spark.range(0, 200).select(F.when(F.col("id") > 0, F.col("id")).alias("k")).groupBy("k").agg((F.max("k") * 2).alias("v"))
    out = lookup(big, small, ["k"], F.col("id"), how=how, bound=50)
    assert out.columns == ["k", "id", "v"]
    got = sorted(out.collect(), key=lambda r: r.id)
    k = {i: i % 300 if i % 7 else None for i in range(600)}
    known = {None: None} | {i: 2 * i for i in range(1, 200)}
    assert [tuple(r) for r in got] == [(k[i], i, known.get(k[i])) for i in range(600) if how == "left" or k[i] in known]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
