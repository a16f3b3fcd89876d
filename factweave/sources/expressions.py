"""Expression trees and commands from the `events` table.

A procedure's events are cut into trees, a new one at each event with k % 4 = 0; an event hangs under the one before it,
or, if k % 4 = 1, under the one before that. Operators follow from the value and the number of children. The root's kind
of event tells the command: purchase and view store the tree's value in a variable, click assumes it, signup allocates
that much, error passes it to a function. k % 3 tells a node's variable, of which 0 is global; v % 3 that which is stored to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.sources.events import points

SPAN = 1_000_000
#: Operators by the number of children, and callees.
LEAVES = ("const", "var", "var", "var", "var")
UNARY = ("cast", "neg", "mem", "sizeof", "index", "field", "not", "cast")
BINARY = ("plus", "plus", "minus", "plus_ptr", "times", "div", "mod", "and", "xor", "lt", "ge", "shift_left", "plus", "or")
TESTS = ("lt", "ge", "eq")
CALLEES = ("strcpy", "strcat", "strncpy", "memcpy", "memmove", "realloc", "strlen", "getc")


def _variable(number: Column) -> Column:
    return F.when(number == 0, F.concat(F.lit("g"), (F.col("user_id") % 20).cast("string"))).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("x"), number.cast("string")))


def _of(names: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a node: tree, node (from 1, the root), parent, pos, op, name, is_global, is_int, to_union, value, and user_id, pid, nid, loc, v, event_type, k of its event."""
    by_time = Window.partitionBy("user_id").orderBy("nid")
    rows = points(spark, sf_dir).withColumn("t", F.sum((F.col("k") % 4 == 0).cast("long")).over(by_time))
    in_tree = Window.partitionBy("user_id", "t").orderBy("nid")
    rows = rows.withColumn("node", F.row_number().over(in_tree).cast("long"))
    rows = rows.withColumn("parent", F.when(F.col("node") == 1, None).otherwise(F.col("node") - F.when((F.col("node") > 2) & (F.col("k") % 4 == 1), 2).otherwise(1)))
    child = lambda n: F.coalesce((F.lead("parent", n).over(in_tree) == F.col("node")).cast("int"), F.lit(0))
    rows = rows.withColumn("n", child(1) + child(2)).withColumn("pos", F.coalesce((F.lag("parent", 1).over(in_tree) == F.col("parent")).cast("int"), F.lit(0)))
    tested = (F.col("node") == 1) & (F.col("event_type") == "click")
    op = F.when(F.col("n") == 0, _of(LEAVES, F.col("v"))).when(F.col("n") == 1, _of(UNARY, F.col("v"))).when(tested, _of(TESTS, F.col("v"))).otherwise(_of(BINARY, F.col("v")))
    return rows.select(
        (F.col("user_id") * SPAN + F.col("t")).alias("tree"), "node", "parent", "pos", op.alias("op"), _variable(F.col("k") % 3).alias("name"), (F.col("k") % 3 == 0).alias("is_global"),
        (F.col("v") % 2 == 0).alias("is_int"), (F.col("v") % 11 == 0).alias("to_union"), F.expr("v div 5 % 4").alias("value"), "user_id", "pid", "nid", "loc", "v", "event_type", "k",
    )


def commands(exprs: DataFrame) -> DataFrame:
    """One row a tree: tree, user_id, pid, kind (set, assume, alloc, call), target (variable stored to), callee, in_loop, file."""
    kind = F.when(F.col("event_type") == "click", "assume").when(F.col("event_type") == "signup", "alloc").when(F.col("event_type") == "error", "call").otherwise("set")
    ends = F.when(F.col("user_id") % 9 == 4, ".y").otherwise(".c")
    return exprs.where("node = 1").select(
        "tree", "user_id", "pid", kind.alias("kind"), _variable(F.col("v") % 3).alias("target"), F.when(F.col("event_type") == "error", _of(CALLEES, F.col("v"))).alias("callee"),
        (F.col("k") % 8 == 4).alias("in_loop"), F.concat(F.lit("p"), F.col("user_id").cast("string"), ends).alias("file"),
    )


def _list_sql(names: tuple[str, ...], number: str) -> str:
    return f"([{', '.join(repr(n) for n in names)}])[{number} % {len(names)} + 1]"


def _variable_sql(number: str) -> str:
    return f"CASE WHEN {number} = 0 THEN 'g' || (user_id % 20) ELSE 'u' || user_id || 'x' || ({number}) END"


EXPR_SQL = f""", x1 AS (SELECT *, sum(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY nid)::BIGINT AS t FROM ev),
 x2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY nid) AS node FROM x1),
 x3 AS (SELECT *, CASE WHEN node = 1 THEN NULL WHEN node > 2 AND k % 4 = 1 THEN node - 2 ELSE node - 1 END AS parent FROM x2),
 x4 AS (SELECT x3.*, (SELECT count(*) FROM x3 c WHERE c.user_id = x3.user_id AND c.t = x3.t AND c.parent = x3.node) AS n, (SELECT count(*) FROM x3 c WHERE c.user_id = x3.user_id AND c.t = x3.t AND c.parent = x3.parent AND c.node < x3.node) AS pos FROM x3),
 ex AS MATERIALIZED (SELECT user_id * {SPAN} + t AS tree, node, parent, pos, CASE WHEN n = 0 THEN {_list_sql(LEAVES, "v")} WHEN n = 1 THEN {_list_sql(UNARY, "v")} WHEN node = 1 AND event_type = 'click' THEN {_list_sql(TESTS, "v")} ELSE {_list_sql(BINARY, "v")} END AS op,
   {_variable_sql("k % 3")} AS name, k % 3 = 0 AS is_global, v % 2 = 0 AS is_int, v % 11 = 0 AS to_union, v // 5 % 4 AS value, user_id, pid, nid, loc, v, event_type, k FROM x4),
 cmd AS (SELECT tree, user_id, pid, CASE event_type WHEN 'click' THEN 'assume' WHEN 'signup' THEN 'alloc' WHEN 'error' THEN 'call' ELSE 'set' END AS kind, {_variable_sql("v % 3")} AS target,
   CASE WHEN event_type = 'error' THEN {_list_sql(CALLEES, "v")} END AS callee, k % 8 = 4 AS in_loop, 'p' || user_id || CASE WHEN user_id % 9 = 4 THEN '.y' ELSE '.c' END AS file FROM ex WHERE node = 1),
 wk AS MATERIALIZED (SELECT tree, node AS top, node, op, '' AS path FROM ex UNION ALL SELECT wk.tree, wk.top, ex.node, ex.op, path || ex.pos FROM wk JOIN ex ON ex.tree = wk.tree AND ex.parent = wk.node)"""
