"""Queries on flow graphs: dominators, frontiers, phi points, def-use edges, orders, fixpoints of loops and taint."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import interval as I
from factweave.operators import components, dominance, sparse
from factweave.operators.taint import tainted
from factweave.plans.catalog import query
from factweave.sources import flow
from factweave.sources.events import calls, points

#: Thresholds of the loops' widening.
STEPS = [64, 256]


def _dominance(spark, sf_dir):
    return dominance.dominance(flow.flow_edges(spark, sf_dir), flow.entries(spark, sf_dir))


@query(flow.FLOW_SQL + " SELECT src, dst FROM cf")
def flow_graph(spark, sf_dir):
    return flow.flow_edges(spark, sf_dir)


@query(flow.DOMINATORS_SQL + """ SELECT node, (SELECT arg_max(sd.d, coalesce(dp.depth, 0)) FROM sd LEFT JOIN dp ON dp.n = sd.d WHERE sd.n = node) AS idom FROM (SELECT DISTINCT node FROM nd)""", recursive=True)
def dominators(spark, sf_dir):
    """Immediate dominators of all points, null at entries."""
    return dominance.immediate_dominators(_dominance(spark, sf_dir))


@query(flow.FRONTIERS_SQL + ' SELECT x AS node, y AS "join" FROM fr', recursive=True)
def dominance_frontiers(spark, sf_dir):
    return dominance.frontiers(_dominance(spark, sf_dir))


def _defs_uses(spark, sf_dir):
    rows = flow.flow_accesses(spark, sf_dir)
    return [rows.where(F.col("kind") == kind).select("node", "loc") for kind in ("def", "use")]


@query(flow.PHI_SQL + " SELECT DISTINCT node, loc FROM ph", recursive=True)
def phi_points(spark, sf_dir):
    """Where different definitions of a location meet."""
    return dominance.phi_points(_dominance(spark, sf_dir), _defs_uses(spark, sf_dir)[0])


@query(flow.DEF_USE_SQL + " SELECT DISTINCT src, dst, loc FROM du", recursive=True)
def def_use_graph(spark, sf_dir):
    """Def-use edges of code with branches and loops."""
    defs, uses = _defs_uses(spark, sf_dir)
    return dominance.def_use(_dominance(spark, sf_dir), defs, uses)


@query()
def wto_order(spark, sf_dir):
    """A weak topological order of the call graph: place, whether a head, components around. SQL can't split components again and again; tested against plain Python."""
    return components.weak_topological_order(calls(spark, sf_dir))


@query(flow.LOOPS_SQL + """ SELECT user_id, loc, 'head' AS point, a AS lo, h AS hi FROM lh UNION ALL SELECT user_id, loc, 'body', a, least(h, c - 1) FROM lh WHERE a <= least(h, c - 1)
 UNION ALL SELECT user_id, loc, 'step', a + s, least(h, c - 1) + s FROM lh WHERE a <= least(h, c - 1) UNION ALL SELECT user_id, loc, 'exit', greatest(a, c), h FROM lh WHERE greatest(a, c) <= h
 UNION ALL SELECT user_id, loc, 'init', a, b FROM lh""")
def loop_fixpoint(spark, sf_dir):
    """Counting loops solved over their def-use edges: heads widen to thresholds or infinity, narrowing then finds the exact bounds, which SQL gives in closed form."""
    edges, commands = flow.loop_facts(flow.counting_loops(spark, sf_dir))
    state = sparse.sparse_fixpoint(edges, commands, components.loop_heads(edges), STEPS)
    place = F.element_at(F.array(*[F.lit(p) for p in flow.LOOP]), (F.col("node") % 10 + 1).cast("int"))
    return state.select(F.expr("node div 100").alias("user_id"), (F.expr("node div 10") % 10).cast("int").alias("loc"), place.alias("point"), "lo", "hi")


@query(flow.LOOPS_SQL + """ SELECT user_id, loc, CASE WHEN a > c - 1 THEN 'BotAlarm' WHEN a >= 0 AND c - 1 < 100 THEN 'Proven' ELSE 'UnProven' END AS status, 'offset: ' || CASE WHEN a > c - 1 THEN 'bot' ELSE '[' || a || ', ' || least(h, c - 1) || ']' END || ', size: [100, 100]' AS descr FROM lh""")
def loop_alarms(spark, sf_dir):
    """Whether a loop's body indexes 100 cells within bounds, from the solved states."""
    loops = flow.counting_loops(spark, sf_dir)
    edges, commands = flow.loop_facts(loops)
    state = sparse.sparse_fixpoint(edges, commands, components.loop_heads(edges), STEPS)
    node = (F.col("user_id") * 10 + F.col("loc")) * 10 + flow.LOOP.index("step")
    inputs = sparse.pulled(edges, state)
    checks = loops.select("user_id", "loc", node.alias("node"), F.lit("x").alias("x_loc"), F.lit(None).cast("string").alias("y_loc"), F.lit("size").alias("size_loc"))
    sizes = checks.select("node", F.lit("size").alias("loc"), F.lit(100).cast("long").alias("lo"), F.lit(100).cast("long").alias("hi"))
    rows = sparse.bounds_alarms(checks, inputs.unionByName(sizes))
    described = F.concat(F.lit("offset: "), I.text(I.Interval(F.col("off_lo"), F.col("off_hi"))), F.lit(", size: "), I.text(I.Interval(F.col("size_lo"), F.col("size_hi"))))
    return rows.select("user_id", "loc", "status", described.alias("descr"))


_TAINT_SQL = flow.DEF_USE_SQL + f""", tp AS (SELECT user_id * {flow.SPAN} + nid AS node, loc, event_type, k, v FROM ev),
 ed AS (SELECT DISTINCT src, dst, loc FROM du),
 cm AS (SELECT node, loc, loc AS x_loc, v % 2 = 0 AS arith, k % 4 = 0 AS endless FROM tp WHERE event_type = 'signup'),
 pe AS (SELECT ed.src, ed.loc, ed.dst, ed.loc AS to_loc FROM ed WHERE NOT EXISTS (SELECT * FROM tp WHERE tp.node = ed.dst AND tp.loc = ed.loc AND event_type IN ('purchase', 'signup'))
   UNION SELECT ed.src, ed.loc, ed.dst, cm.loc FROM ed JOIN cm ON cm.node = ed.dst AND cm.x_loc = ed.loc),
 sr AS (SELECT node, loc, node AS source FROM tp WHERE event_type = 'purchase' AND v % 5 = 0 UNION SELECT pe.dst, pe.to_loc, sr.source FROM sr JOIN pe ON pe.src = sr.node AND pe.loc = sr.loc),
 fs AS (SELECT DISTINCT cm.node, cm.loc FROM cm JOIN ed ON ed.dst = cm.node AND ed.loc = cm.x_loc JOIN sr ON sr.node = ed.src AND sr.loc = ed.loc WHERE arith AND endless),
 fl AS (SELECT node, loc FROM fs UNION SELECT pe.dst, pe.to_loc FROM fl JOIN pe ON pe.src = fl.node AND pe.loc = fl.loc)"""


def _taint_edges_sql() -> str:
    """Signups use what they define, so their edges are asked for as well."""
    return _TAINT_SQL.replace("WHEN event_type IN ('view', 'click') THEN 'use' END AS kind FROM ev)", "WHEN event_type IN ('view', 'click') THEN 'use' END AS kind FROM ev UNION ALL SELECT user_id * 1000000 + nid, loc, 'use' FROM ev WHERE event_type = 'signup')")


@query(_taint_edges_sql() + """ SELECT tp.node, tp.loc, sr.source, CASE WHEN bool_or(fl.node IS NOT NULL) THEN 'UnProven' ELSE 'Proven' END AS status
 FROM tp JOIN ed ON ed.dst = tp.node AND ed.loc = tp.loc JOIN sr ON sr.node = ed.src AND sr.loc = ed.loc LEFT JOIN (SELECT DISTINCT node, loc FROM fl) fl ON fl.node = ed.src AND fl.loc = ed.loc
 WHERE tp.event_type = 'view' GROUP BY tp.node, tp.loc, sr.source""", recursive=True)
def taint_alarms(spark, sf_dir):
    """Views are allocations whose size is what is stored: one alarm for each input that reaches them, unproven if the size may have overflowed on the way.

    Purchases of a multiple of 5 are inputs; signups store a new value made of the old, by arithmetic if theirs is even, on a value without bounds if k is a multiple of 4.
    """
    rows = points(spark, sf_dir).withColumn("node", F.col("user_id") * flow.SPAN + F.col("nid"))
    defs, uses = _defs_uses(spark, sf_dir)
    made = rows.where("event_type = 'signup'")
    edges = dominance.def_use(_dominance(spark, sf_dir), defs, uses.unionByName(made.select("node", "loc")))
    commands = made.select("node", "loc", F.col("loc").alias("x_loc"), (F.col("v") % 2 == 0).alias("arithmetic"), (F.col("k") % 4 == 0).alias("endless"))
    sources = rows.where("event_type = 'purchase' and v % 5 = 0").select("node", "loc", F.col("node").alias("source"), F.lit(False).alias("overflow"))
    plain = rows.where("event_type = 'purchase'").select("node", "loc")
    at = rows.where("event_type = 'view'").select("node", "loc")
    return tainted(edges, commands, sources, plain, at)
