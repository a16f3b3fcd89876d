"""Queries on expression trees: nesting, constants, checks and the filters that look at expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import alarm_queries as Q
from factweave.operators import expressions as E
from factweave.operators.graph import cut
from factweave.plans.catalog import SIZES_SQL, query, sizes
from factweave.plans.lattice import without_parts
from factweave.sources.expressions import EXPR_SQL, commands, expressions

_NESTED_SQL = EXPR_SQL + """, nn AS (SELECT tree, node, row_number() OVER (PARTITION BY tree ORDER BY path) AS pre, length(path) AS depth FROM wk WHERE top = 1),
 sz0 AS (SELECT tree, top AS node, count(*) AS size FROM wk GROUP BY ALL)"""


def nodes_of(spark, sf_dir):
    return E.nested(expressions(spark, sf_dir))


@query(_NESTED_SQL + ' SELECT tree, node, pre, pre + size - 1 AS "last", depth FROM nn JOIN sz0 USING (tree, node)', recursive=True)
def expression_nesting(spark, sf_dir):
    """Numbers of all expressions' nodes in the order of writing, the last below each, and depths."""
    return nodes_of(spark, sf_dir).select("tree", "node", "pre", "last", F.col("depth").cast("long").alias("depth"))


#: Everything under sizeof is constant, so only the rest is walked.
_SEEN_SQL = ", se AS (SELECT tree, node, op FROM ex WHERE node = 1 UNION ALL SELECT ex.tree, ex.node, ex.op FROM se JOIN ex ON ex.tree = se.tree AND ex.parent = se.node WHERE se.op <> 'sizeof')"


@query(EXPR_SQL + _SEEN_SQL + " SELECT tree, NOT bool_or(op IN ('var', 'mem', 'index', 'field')) AS is_const FROM se GROUP BY tree", recursive=True)
def constant_expressions(spark, sf_dir):
    """Whether an expression is made of constants and sizes only."""
    seen = E.barred(nodes_of(spark, sf_dir), F.col("op") != "sizeof").where("bar = 0")
    return seen.groupBy("tree").agg((~F.bool_or(F.col("op").isin("var", "mem", "index", "field"))).alias("is_const"))


_CHECKS_SQL = EXPR_SQL + _SEEN_SQL + SIZES_SQL + """, ch AS (
  SELECT s.tree, s.node, CASE WHEN s.op = 'index' THEN 'array' WHEN s.op IN ('mem', 'field') THEN 'deref' ELSE 'div' END AS kind, c.node AS sub, c.op AS sub_op, c.is_global AS sub_global
  FROM se s JOIN ex c ON c.tree = s.tree AND c.parent = s.node AND c.pos = CASE WHEN s.op IN ('div', 'mod') THEN 1 ELSE 0 END WHERE s.op IN ('index', 'mem', 'field', 'div', 'mod')
  UNION ALL SELECT tree, 1, callee, NULL, NULL, NULL FROM cmd WHERE callee IN ('strcpy', 'strcat', 'strncpy', 'memcpy', 'memmove')),
 qs AS (SELECT ch.*, ex.pid, ex.loc, cmd.file, cmd.user_id, CASE WHEN sz.lo IS NULL THEN 'BotAlarm' WHEN ex.v < sz.lo THEN 'Proven' ELSE 'UnProven' END AS status
  FROM ch JOIN ex ON ex.tree = ch.tree AND ex.node = ch.node JOIN cmd ON cmd.tree = ch.tree LEFT JOIN sz ON sz.pid = ex.pid AND sz.loc = ex.loc)"""


def checks(spark, sf_dir):
    """The nodes, and the checks with the status that the sizes at their location give: none is bottom, a value below all of them is proven."""
    exprs = expressions(spark, sf_dir)
    nodes = cut(E.nested(exprs), "nodes")
    made = commands(exprs)
    where = nodes.select("tree", "node", "pid", "loc", "v")
    size = sizes(spark, sf_dir).select("pid", "loc", F.col("lo").alias("size_lo"))
    status = F.when(F.col("size_lo").isNull(), "BotAlarm").when(F.col("v") < F.col("size_lo"), "Proven").otherwise("UnProven")
    rows = Q.collect(nodes, made).join(where, ["tree", "node"]).join(made.select("tree", "file", "user_id"), "tree").join(size, ["pid", "loc"], "left")
    return nodes, rows.withColumn("status", status).drop("v", "size_lo")


@query(_CHECKS_SQL + " SELECT tree, node, kind, sub, status FROM qs", recursive=True)
def generate_queries(spark, sf_dir):
    """All checks of all commands."""
    return checks(spark, sf_dir)[1].select("tree", "node", "kind", "sub", "status")


def _filtered_sql(condition: str) -> str:
    return _CHECKS_SQL + f", un AS (SELECT * FROM qs WHERE status = 'UnProven') SELECT tree, node, kind, pid, loc FROM un WHERE (pid, loc) NOT IN (SELECT (pid, loc) FROM un WHERE {condition})"


def _unproven_without(spark, sf_dir, *conditions):
    rows = cut(checks(spark, sf_dir)[1].where("status = 'UnProven'"), "unproven")
    return without_parts(rows, ["pid", "loc"], *conditions).select("tree", "node", "kind", "pid", "loc")


_LIB = "kind NOT IN ('array', 'deref', 'div')"
_COMPLEX = "(kind = 'array' AND sub_op IN ('and', 'or', 'xor')) OR (kind IN ('array', 'deref') AND sub_op IN ('var', 'index') AND sub_global)"


@query(_filtered_sql(_LIB), recursive=True)
def filter_lib(spark, sf_dir):
    """Unproven alarms but for locations with a checked library call."""
    return _unproven_without(spark, sf_dir, Q.is_library())


@query(_filtered_sql(_COMPLEX), recursive=True)
def filter_complex_exp(spark, sf_dir):
    """Unproven alarms but for locations with an index of bits, or an index or address that is global."""
    return _unproven_without(spark, sf_dir, Q.is_complex())


@query(_CHECKS_SQL + """, wl AS (SELECT tree, sub AS top, sub AS node FROM ch WHERE kind IN ('array', 'deref')
  UNION SELECT wl.tree, wl.top, c.node FROM wl JOIN ex p ON p.tree = wl.tree AND p.node = wl.node JOIN ex c ON c.tree = wl.tree AND c.parent = wl.node
   WHERE p.op IN ('cast', 'plus', 'minus', 'plus_ptr', 'times', 'div', 'mod', 'and', 'or', 'xor', 'lt', 'ge', 'eq', 'shift_left')),
 bad AS (SELECT DISTINCT wl.tree, wl.top FROM wl JOIN ex e ON e.tree = wl.tree AND e.node = wl.node LEFT JOIN ex f ON f.tree = e.tree AND f.parent = e.node AND f.pos = 0 LEFT JOIN ex s ON s.tree = e.tree AND s.parent = e.node AND s.pos = 1
  WHERE e.op IN ('index', 'mem', 'mod', 'shift_left', 'and', 'or', 'xor') OR (e.op = 'plus_ptr' AND f.op IN ('mem', 'field')) OR (e.op IN ('plus', 'minus') AND f.op IN ('var', 'index') AND s.op IN ('var', 'index'))
   OR (e.op = 'var' AND (e.to_union OR (e.is_global AND e.is_int))))
 SELECT tree, node, kind, CASE WHEN count(*) FILTER (status = 'UnProven') OVER (PARTITION BY tree) > 1 THEN 'Proven' ELSE status END AS status FROM qs
 WHERE file NOT LIKE '%.y' AND user_id <> 0 AND NOT EXISTS (SELECT * FROM bad WHERE bad.tree = qs.tree AND bad.top = qs.sub AND kind IN ('array', 'deref'))""", recursive=True)
def unsound_filter(spark, sf_dir):
    """Checks outside generated files and the global procedure (0) whose expression is trusted; where a command keeps over one unproven check, they count as proven."""
    nodes, rows = checks(spark, sf_dir)
    written = rows.where("user_id <> 0 and not endswith(file, '.y') and not endswith(file, '.yy.c') and not endswith(file, '.simple')")
    return Q.calmed(Q.trusted(written, nodes), ["tree"], most=1).select("tree", "node", "kind", "status")
