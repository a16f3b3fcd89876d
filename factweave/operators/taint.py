"""Taint over def-use edges: which inputs reach a location, and whether arithmetic on them may have overflowed.

A value is a set of inputs and a flag. Sets are rows (node, loc, source), flags rows (node, loc); both spread along the
same steps from one defined location to the next, and only rows that are new go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.graph import cut, spread


def _pair(node: str, loc: str):
    return F.struct(F.col(node).alias("node"), F.col(loc).alias("loc"))


def steps(edges: DataFrame, commands: DataFrame, constant: DataFrame) -> DataFrame:
    """(src, dst) between pairs (node, loc): along an edge (src, dst, loc) into the location that a command of its end makes of it, or on in the same one where its end doesn't define it."""
    defined = commands.select("node", "loc").unionByName(constant.select("node", "loc")).distinct().select(F.col("node").alias("dst"), "loc")
    passed = edges.join(defined, ["dst", "loc"], "left_anti").select(_pair("src", "loc").alias("src"), _pair("dst", "loc").alias("dst"))
    made = edges.join(commands.select(F.col("node").alias("dst"), F.col("x_loc").alias("loc"), F.col("loc").alias("to")), ["dst", "loc"])
    return passed.unionByName(made.select(_pair("src", "loc").alias("src"), _pair("dst", "to").alias("dst"))).distinct()


def tainted(edges: DataFrame, commands: DataFrame, sources: DataFrame, constant: DataFrame, at: DataFrame) -> DataFrame:
    """(node, loc, source, status) for each of `at` (node, loc) and each input that reaches it: UnProven if its value may have overflowed, else Proven.

    `commands` (node, loc, x_loc, arithmetic, endless) make loc of x_loc, with several rows for several operands; arithmetic on
    an operand that is tainted and endless (has an infinite bound) may overflow. `sources` (node, loc, source, overflow) bring
    inputs, and the flag if `overflow`; `constant` (node, loc) are definitions that use nothing. Nulls in edges give nothing.
    """
    edges = cut(edges.where("src is not null and dst is not null and loc is not null").select("src", "dst", "loc").distinct(), "taint-edges")
    back = cut(steps(edges, commands, constant).select(F.col("dst").alias("src"), F.col("src").alias("dst")), "taint-steps")  # marks spread against edges
    reached = cut(spread(back, sources.select(_pair("node", "loc").alias("node"), "source")).select("node.node", "node.loc", "source"), "taint-sources")
    into = reached.select(F.col("node").alias("src"), "loc", "source").join(edges, ["src", "loc"])
    risky = commands.where("arithmetic and endless").select(F.col("node").alias("dst"), F.col("x_loc").alias("loc"), F.col("loc").alias("to"))
    starts = into.join(risky, ["dst", "loc"]).select(_pair("dst", "to").alias("node")).unionByName(sources.where("overflow").select(_pair("node", "loc").alias("node"))).distinct()
    flags = spread(back, starts.withColumn("flag", F.lit(True))).select(F.col("node.node").alias("src"), F.col("node.loc").alias("loc"), "flag")
    found = into.join(flags, ["src", "loc"], "left").join(at.select(F.col("node").alias("dst"), "loc").distinct(), ["dst", "loc"])
    return found.groupBy(F.col("dst").alias("node"), "loc", "source").agg(F.when(F.bool_or(F.coalesce("flag", F.lit(False))), "UnProven").otherwise("Proven").alias("status"))
