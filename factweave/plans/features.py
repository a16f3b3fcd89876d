"""Queries on features of locations: what commands say of them, closures over copies, scores, ranks and the selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import components, features
from factweave.operators.graph import cut
from factweave.operators.ranking import ranked, take_top
from factweave.plans.catalog import _CLOSURE_SQL, query
from factweave.plans.expressions import nodes_of
from factweave.sources.events import calls
from factweave.sources.expressions import EXPR_SQL, commands

#: Weights by number (from 1, in halves, so that sums are exact), and the share that is selected.
WEIGHTS = [((7 * n) % 19 - 9) / 2 for n in range(1, 46)]
SELECTED = 30

_TWO = "('plus', 'minus', 'plus_ptr', 'times', 'div', 'mod', 'and', 'or', 'xor', 'lt', 'ge', 'eq', 'shift_left')"
_FEATURES_SQL = _CLOSURE_SQL + EXPR_SQL + f""", hid AS (SELECT DISTINCT tree, node FROM wk WHERE node <> top AND (tree, top) IN (SELECT (tree, node) FROM ex WHERE op = 'sizeof')),
 vs AS MATERIALIZED (SELECT * FROM ex WHERE (tree, node) NOT IN (SELECT (tree, node) FROM hid)),
 sub AS MATERIALIZED (SELECT wk.tree, wk.top, vs.node, vs.op, vs.name FROM wk JOIN vs USING (tree, node)),
 cn AS (SELECT tree, top AS node, NOT bool_or(op IN ('var', 'mem', 'index', 'field')) AS is_const FROM sub GROUP BY ALL),
 rd AS (SELECT tree, top, name FROM sub WHERE op IN ('var', 'index')),
 rt AS (SELECT cmd.*, e.op, a.op AS o1, a.name AS n1, b.op AS o2, b.value AS v2, cn.is_const, cb.is_const AS const2, cmd.user_id IN (SELECT src FROM tc WHERE src = dst) AS rec
  FROM cmd JOIN (SELECT tree, node, op FROM ex WHERE node = 1) e USING (tree) JOIN cn ON cn.tree = e.tree AND cn.node = 1
  LEFT JOIN vs a ON a.tree = e.tree AND a.parent = 1 AND a.pos = 0 LEFT JOIN vs b ON b.tree = e.tree AND b.parent = 1 AND b.pos = 1 LEFT JOIN cn cb ON cb.tree = b.tree AND cb.node = b.node),
 st AS (SELECT *, o1 = 'var' AND n1 = target AS self FROM rt WHERE kind = 'set'),
 ask AS (SELECT p.tree, p.op AS asks, c.node, c.op FROM vs p JOIN vs c ON c.tree = p.tree AND c.parent = p.node WHERE p.op IN ('index', 'mem', 'field')),
 f1 AS (
  SELECT target AS loc, 'assign_const' AS feature FROM st WHERE is_const UNION SELECT target, 'assign_sizeof' FROM st WHERE op = 'sizeof'
  UNION SELECT target, 'inc_itself_by_one' FROM st WHERE op = 'plus' AND self AND o2 = 'const' AND v2 = 1 UNION SELECT target, 'inc_itself_by_const' FROM st WHERE op = 'plus' AND self AND o2 = 'const' AND v2 > 1
  UNION SELECT target, 'inc_itself_by_var' FROM st WHERE op = 'plus' AND self AND o2 = 'var' UNION SELECT target, 'incptr_itself_by_one' FROM st WHERE op = 'plus_ptr' AND self AND o2 = 'const' AND v2 = 1
  UNION SELECT target, 'incptr_itself_by_const' FROM st WHERE op = 'plus_ptr' AND self AND o2 = 'const' AND v2 > 1 UNION SELECT target, 'mul_itself_by_const' FROM st WHERE op = 'times' AND self AND o2 = 'const' AND v2 > 1
  UNION SELECT target, 'mul_itself_by_var' FROM st WHERE op = 'times' AND self AND o2 = 'var' UNION SELECT target, 'dec_itself' FROM st WHERE op = 'minus' AND self
  UNION SELECT target, 'inc' FROM st WHERE op = 'plus' UNION SELECT target, 'dec' FROM st WHERE op = 'minus' UNION SELECT target, 'mod_in_rec_fun' FROM st WHERE rec UNION SELECT target, 'mod_inside_loops' FROM st WHERE in_loop
  UNION SELECT n1, 'prune_by_const' FROM rt WHERE kind = 'assume' AND op IN ('lt', 'ge', 'eq') AND o1 IN ('var', 'index') AND const2 UNION SELECT n1, 'prune_by_var' FROM rt WHERE kind = 'assume' AND op IN ('lt', 'ge', 'eq') AND o1 IN ('var', 'index') AND o2 = 'var'
  UNION SELECT n1, 'prune_by_not' FROM rt WHERE kind = 'assume' AND op = 'not' AND o1 IN ('var', 'index') UNION SELECT target, 'return_from_alloc' FROM rt WHERE kind = 'alloc' UNION SELECT target, 'return_from_realloc' FROM rt WHERE callee = 'realloc'
  UNION SELECT name, 'pass_to_alloc' FROM rd JOIN cmd USING (tree) WHERE top = 1 AND kind = 'alloc' UNION SELECT name, 'pass_to_realloc' FROM rd JOIN cmd USING (tree) WHERE top = 1 AND callee = 'realloc'
  UNION SELECT name, 'return_from_ext_fun' FROM rd JOIN cmd USING (tree) WHERE top = 1 AND callee NOT IN ('realloc', 'strlen') UNION SELECT name, 'used_inside_loops' FROM rd JOIN cmd USING (tree) WHERE top = 1 AND kind = 'set' AND in_loop
  UNION SELECT name, 'used_as_array_buf' FROM vs WHERE op = 'index'
  UNION SELECT rd.name, 'used_as_array_index' FROM ask JOIN rd ON rd.tree = ask.tree AND rd.top = ask.node WHERE asks = 'index'
  UNION SELECT rd.name, 'used_as_array_buf' FROM ask JOIN rd ON rd.tree = ask.tree AND rd.top = ask.node WHERE asks <> 'index' AND ask.op NOT IN {_TWO}
  UNION SELECT rd.name, CASE WHEN c.pos = 1 THEN 'used_as_array_index' ELSE 'used_as_array_buf' END FROM ask JOIN vs c ON c.tree = ask.tree AND c.parent = ask.node JOIN rd ON rd.tree = c.tree AND rd.top = c.node WHERE asks <> 'index' AND ask.op IN {_TWO}),
 ca AS (SELECT tree, node, op, name FROM ex WHERE node = 1 UNION ALL SELECT ex.tree, ex.node, ex.op, ex.name FROM ca JOIN ex ON ex.tree = ca.tree AND ex.parent = ca.node WHERE ca.op = 'cast'),
 cp AS (SELECT DISTINCT name AS src, target AS dst FROM ca JOIN cmd USING (tree) WHERE kind = 'set' AND op = 'var'),
 cl AS (SELECT loc, feature FROM f1 WHERE feature IN ('pass_to_alloc', 'pass_to_realloc', 'used_as_array_buf', 'return_from_alloc', 'return_from_realloc')
  UNION SELECT CASE WHEN feature LIKE 'return%' THEN dst ELSE src END, feature FROM cl JOIN cp ON CASE WHEN feature LIKE 'return%' THEN src ELSE dst END = loc),
 vl AS (SELECT name AS loc FROM ex UNION SELECT target FROM cmd),
 ft AS MATERIALIZED (SELECT loc, feature FROM f1 UNION SELECT loc, CASE feature WHEN 'used_as_array_buf' THEN 'pass_to_buf' ELSE feature || '_clos' END FROM (SELECT * FROM cl EXCEPT SELECT * FROM f1)
  UNION SELECT loc, CASE WHEN loc LIKE 'g%' THEN 'gvars' ELSE 'lvars' END FROM vl
  UNION SELECT target, 'single_defs' FROM cmd WHERE kind IN ('set', 'alloc') OR callee = 'realloc' GROUP BY target HAVING count(*) = 1)"""


def _located(spark, sf_dir):
    """(loc, feature) of all kinds, and the locations."""
    nodes = cut(nodes_of(spark, sf_dir), "nodes")
    made = cut(commands(nodes).withColumn("proc", F.col("user_id")), "commands")
    recursive = components.cyclic_nodes(calls(spark, sf_dir)).select(F.col("node").alias("proc"))
    found = cut(features.commands_features(nodes, made, recursive), "features")
    far = features.closures(found, features.copies(nodes, made))
    locations = nodes.select(F.col("name").alias("loc")).unionByName(made.select(F.col("target").alias("loc"))).distinct()
    kinds = locations.select("loc", F.when(F.startswith("loc", F.lit("g")), "gvars").otherwise("lvars").alias("feature"))
    stores = made.where("kind in ('set', 'alloc') or callee = 'realloc'").groupBy(F.col("target").alias("loc")).agg(F.count("*").alias("n"))
    single = stores.where("n = 1").select("loc", F.lit("single_defs").alias("feature"))
    return found.unionByName(far).unionByName(kinds).unionByName(single), locations


@query(_FEATURES_SQL + " SELECT loc, feature FROM ft", recursive=True)
def location_features(spark, sf_dir):
    """All features of all locations, a row each."""
    return _located(spark, sf_dir)[0]


def _has(*names: str) -> str:
    return f"coalesce(list_has_any(fs, [{', '.join(repr(n) for n in names)}]), false)"


def _weight_sql() -> str:
    terms = [(_has(f), w) for f, w in zip(features.ATOMIC, WEIGHTS)]
    for (groups, never), w in zip(features.RULES, WEIGHTS[len(features.ATOMIC) :]):
        terms.append((" AND ".join([_has(*g) for g in groups] + [f"NOT {_has(n)}" for n in never]), w))
    return " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, w in terms)


_SCORES_SQL = _FEATURES_SQL + f", al AS (SELECT loc, list(feature) AS fs FROM vl LEFT JOIN ft USING (loc) GROUP BY loc), sw AS (SELECT loc, {_weight_sql()} AS weight FROM al), rk AS (SELECT *, row_number() OVER (ORDER BY weight DESC, loc) AS rank FROM sw)"


def _scored(spark, sf_dir):
    found, locations = _located(spark, sf_dir)
    return features.scores(locations, found, WEIGHTS)


@query(_SCORES_SQL + ' SELECT loc, weight, rank FROM rk', recursive=True)
def feature_score(spark, sf_dir):
    """Locations by the weights of their features and of combinations of them, heaviest first."""
    return ranked(_scored(spark, sf_dir), [F.desc("weight"), F.asc("loc")]).select("loc", "weight", "rank")


@query(_SCORES_SQL + f" SELECT loc FROM rk WHERE rank <= (SELECT count(*) FROM rk) * {SELECTED} // 100", recursive=True)
def feature_select(spark, sf_dir):
    """The locations that are worth a flow-sensitive analysis: the heaviest share of all."""
    return take_top(_scored(spark, sf_dir), [F.desc("weight"), F.asc("loc")], SELECTED).select("loc")
