"""What a program's commands have to be checked for, and the filters that look at the checked expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators import expressions as E

#: Operators with two operands, library calls that are checked, and operators whose bounds are not trusted.
BINARY = ("plus", "minus", "plus_ptr", "times", "div", "mod", "and", "or", "xor", "lt", "le", "gt", "ge", "eq", "ne", "shift_left", "shift_right", "land", "lor")
CHECKED_CALLS = ("strcpy", "strcat", "strncpy", "memcpy", "memmove")
UNTRUSTED = ("mod", "shift_left", "shift_right", "and", "or", "xor", "land", "lor")
BITWISE = ("and", "or", "xor")


def collect(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(tree, node, kind, sub, top_pre, top_last, sub_op, sub_global): the checks of all expressions. `nodes` are those of nested().

    An index checks the index (kind array), a dereference and a field behind one the address (deref), a division and a
    remainder the divisor (div), a checked call (`calls`: tree, callee) its arguments (kind: the callee; no sub-expression).
    What stands under sizeof is never evaluated, so not checked.
    """
    seen = E.barred(nodes, F.col("op") != "sizeof").where("bar = 0")
    kind = F.when(F.col("op") == "index", "array").when(F.col("op").isin("mem", "field"), "deref").when(F.col("op").isin("div", "mod"), "div")
    asked = seen.withColumn("kind", kind).where("kind is not null").select("tree", "node", "kind", F.when(F.col("kind") == "div", 1).otherwise(0).alias("pos"))
    sub = nodes.where("parent is not null").select("tree", F.col("parent").alias("node"), "pos", F.col("node").alias("sub"), F.col("pre").alias("top_pre"), F.col("last").alias("top_last"), F.col("op").alias("sub_op"), F.col("is_global").alias("sub_global"))
    found = asked.join(sub, ["tree", "node", "pos"]).drop("pos")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sub", "long"), ("top_pre", "long"), ("top_last", "long"), ("sub_op", "string"), ("sub_global", "boolean"))]
    roots = nodes.where("parent is null").select("tree", "node").join(calls.where(F.col("callee").isin(*CHECKED_CALLS)).select("tree", F.col("callee").alias("kind")), "tree")
    return found.unionByName(roots.select("tree", "node", "kind", *none))


def is_library() -> Column:
    return F.col("kind").isin(*CHECKED_CALLS)


def is_complex() -> Column:
    """An index made by bits, or an index or address that is (or starts from) a global variable."""
    bits = (F.col("kind") == "array") & F.col("sub_op").isin(*BITWISE)
    return bits | (F.col("kind").isin("array", "deref") & F.col("sub_op").isin("var", "index") & F.col("sub_global"))


def trusted(checks: DataFrame, nodes: DataFrame) -> DataFrame:
    """`checks` (of collect()) without those of an index or address whose bounds aren't trusted.

    That is one that, through operators of two operands and casts alone, comes from bits, shifts, remainders or logic; from
    the sum or difference of two variables; from an element, a dereference, a pointer to a union or a global integer; or
    from an address beside what is behind a pointer.
    """
    marked = E.barred(E.with_children(nodes, ["op"]), F.col("op").isin("cast", *BINARY))
    first, second = F.col("first.op"), F.col("second.op")
    variable = lambda op: op.isin("var", "index")
    odd = F.col("op").isin("index", "mem", *UNTRUSTED) | ((F.col("op") == "plus_ptr") & first.isin("mem", "field")) | (F.col("op").isin("plus", "minus") & variable(first) & variable(second))
    odd = odd | ((F.col("op") == "var") & (F.col("to_union") | (F.col("is_global") & F.col("is_int"))))
    asked = checks.where("kind in ('array', 'deref')")
    return E.none_below(marked, asked, F.coalesce(odd, F.lit(False))).unionByName(checks.where("kind not in ('array', 'deref')"))


def calmed(alarms: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """`alarms` with those of a point (by `keys`) with over `most` unproven ones taken for proven."""
    n = F.count_if(F.col("status") == "UnProven").over(Window.partitionBy(*keys))
    return alarms.withColumn("status", F.when(n > most, "Proven").otherwise(F.col("status")))
