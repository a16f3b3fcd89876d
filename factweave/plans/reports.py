"""Map and set orders, edges between procedures, further checkers, reports, streamed facts and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.functions import interval as I
from factweave.operators import components
from factweave.operators.ranking import ranked, take_top
from factweave.plans.catalog import (
    _ACCESS_SQL, _ALARMS_SQL, _OWNED_SQL, _CLOSURE_SQL, ORACLES, PAIRS_SQL, SIZES_SQL, STATES_SQL, _sets, access_proc_local, access_reach, accesses, reach, bounds_check, div_zero_check, pairs, query, sizes, states,
)
from factweave.sources import store
from factweave.sources.events import calls, owned, points
from factweave.streaming.facts import streamed_states


@query(PAIRS_SQL + " SELECT pid, loc, CASE WHEN greatest(a, c) <= least(b, d) THEN greatest(a, c) END AS lo, CASE WHEN greatest(a, c) <= least(b, d) THEN least(b, d) END AS hi FROM pr")
def map_meet(spark, sf_dir):
    """Keys of both maps; an empty meet stays as bottom (nulls)."""
    rows, x, y = pairs(spark, sf_dir)
    return rows.select("pid", "loc", *I.meet(x, y).alias())


@query(STATES_SQL + SIZES_SQL + """ SELECT pid, bool_and(st.lo IS NULL OR (sz.lo IS NOT NULL AND sz.lo <= st.lo AND st.hi <= sz.hi)) AS is_le
  FROM st FULL JOIN sz USING (pid, loc) GROUP BY pid""")
def map_le(spark, sf_dir):
    """Whether each key's interval lies in the other map's; a missing key is bottom."""
    other = sizes(spark, sf_dir).select("pid", "loc", F.col("lo").alias("c"), F.col("hi").alias("d"))
    rows = states(spark, sf_dir).join(other, ["pid", "loc"], "full")
    return rows.groupBy("pid").agg(F.bool_and(I.le(I.interval("lo", "hi"), I.interval("c", "d"))).alias("is_le"))


@query(PAIRS_SQL + f""", wd AS (SELECT *, CASE WHEN c < a THEN {I.NEG} ELSE a END AS lo, CASE WHEN d > b THEN {I.POS} ELSE b END AS hi FROM pr)
 SELECT pid, loc, CAST(CASE WHEN lo = {I.NEG} THEN greatest(least(a, c), 10) ELSE lo END AS BIGINT) AS lo, CAST(CASE WHEN hi = {I.POS} THEN greatest(b, d) ELSE hi END AS BIGINT) AS hi FROM wd WHERE greatest(b, d) >= 10""")
def map_narrow(spark, sf_dir):
    """Keys of both maps, widened without thresholds, then narrowed to the join from 10 up; finite bounds stay."""
    rows, x, y = pairs(spark, sf_dir)
    wide = I.widen(x, y, [])
    return rows.select("pid", "loc", *I.narrow(wide, I.meet(I.meet(I.join(x, y), wide), I.Interval(F.lit(10).cast("long"), F.lit(I.POS)))).alias()).where("lo is not null")


@query(""", x AS (SELECT DISTINCT pid, loc FROM ev WHERE event_type = 'purchase'), y AS (SELECT DISTINCT pid, loc FROM ev WHERE event_type = 'view'), p AS (SELECT DISTINCT pid FROM ev)
 SELECT pid, (SELECT count(*) FROM x WHERE x.pid = p.pid) AS n_x, (SELECT count(*) FROM y WHERE y.pid = p.pid) AS n_y,
   NOT EXISTS (SELECT * FROM x WHERE x.pid = p.pid AND NOT EXISTS (SELECT * FROM y WHERE y.pid = x.pid AND y.loc = x.loc)) AS is_subset FROM p""")
def powerset_le(spark, sf_dir):
    return _sets(spark, sf_dir).select("pid", F.size("x").cast("long").alias("n_x"), F.size("y").cast("long").alias("n_y"), (F.size(F.array_except("x", "y")) == 0).alias("is_subset"))


_REACH_SQL = _CLOSURE_SQL + _ACCESS_SQL + """, own AS (SELECT DISTINCT user_id, loc, kind FROM ac WHERE kind IS NOT NULL), hull AS (SELECT src, dst FROM tc UNION SELECT DISTINCT user_id, user_id FROM ev),
 ar AS (SELECT DISTINCT src AS proc, loc, kind FROM hull JOIN own ON dst = user_id)"""


@query(_CLOSURE_SQL + _OWNED_SQL + """, own AS (SELECT DISTINCT user_id, loc, kind FROM oc), hull AS (SELECT src, dst FROM tc UNION SELECT DISTINCT user_id, user_id FROM ev),
 ar AS (SELECT DISTINCT src AS proc, loc, kind FROM hull JOIN own ON dst = user_id)
 SELECT proc, loc, kind FROM ar WHERE loc NOT IN (SELECT loc FROM own GROUP BY loc HAVING count(DISTINCT user_id) = 1)""", recursive=True)
def access_reach_wo_local(spark, sf_dir):
    """access_reach without the locations that one procedure alone touches."""
    return reach(spark, sf_dir, owned(accesses(spark, sf_dir))).join(access_proc_local(spark, sf_dir).select("loc"), "loc", "left_anti").select("proc", "loc", "kind")


@query(_REACH_SQL + """ SELECT 'call' AS edge, e.src, e.dst, loc FROM edges e JOIN ar ON proc = e.dst AND kind = 'use'
 UNION ALL SELECT 'return', e.dst, e.src, loc FROM edges e JOIN ar ON proc = e.dst AND kind = 'def'""", recursive=True)
def inter_dug(spark, sf_dir):
    """Def-use edges between procedures: into a callee for what it and its callees use, back for what they define."""
    reach = access_reach(spark, sf_dir).withColumnRenamed("proc", "dst")
    rows, call = calls(spark, sf_dir).join(reach, "dst"), F.col("kind") == "use"
    ends = F.when(call, F.struct(F.lit("call").alias("edge"), F.col("src"), F.col("dst"))).otherwise(F.struct(F.lit("return").alias("edge"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    return rows.select(ends.alias("e"), "loc").select("e.edge", "e.src", "e.dst", "loc")


@query(""" SELECT pid, nid, loc, CASE WHEN n = 0 THEN 'BotAlarm' WHEN nulls = 0 THEN 'Proven' ELSE 'UnProven' END AS status FROM
 (SELECT *, count(*) FILTER (event_type = 'purchase') OVER w AS n, count(*) FILTER (event_type = 'purchase' AND v % 5 = 0) OVER w AS nulls FROM ev
  WINDOW w AS (PARTITION BY pid, loc ORDER BY nid ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'view'""")
def null_check(spark, sf_dir):
    """Reads through what is stored, a multiple of 5 being null: may it be null?"""
    so_far = Window.partitionBy("pid", "loc").orderBy("nid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stored = F.col("event_type") == "purchase"
    rows = points(spark, sf_dir).where("event_type in ('view', 'purchase')").withColumn("n", F.count_if(stored).over(so_far)).withColumn("nulls", F.count_if(stored & (F.col("v") % 5 == 0)).over(so_far))
    status = F.when(F.col("n") == 0, "BotAlarm").when(F.col("nulls") == 0, "Proven").otherwise("UnProven")
    return rows.where("event_type = 'view'").select("pid", "nid", "loc", status.alias("status"))


def _as_cte(name: str, of: str) -> str:
    """The text after the shared views of query `of`, as a further view."""
    return f", {name} AS (" + ORACLES[of].split(store.AFTER_VIEWS, 1)[1] + ")"


@query(_ALARMS_SQL + _as_cte("dz", "div_zero_check") + _as_cte("nd", "null_check") + """ SELECT checker, status, count(*) AS n FROM
 (SELECT 'BO' AS checker, status FROM al UNION ALL SELECT 'DZ', status FROM dz UNION ALL SELECT 'ND', status FROM nd) GROUP BY ALL""")
def inspect_alarm(spark, sf_dir):
    """All checkers' verdicts, counted."""
    found = [f(spark, sf_dir).select(F.lit(c).alias("checker"), "status") for c, f in (("BO", bounds_check), ("DZ", div_zero_check), ("ND", null_check))]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("checker", "status").agg(F.count("*").alias("n"))


@query(_ALARMS_SQL + _CLOSURE_SQL + " SELECT pid, nid, loc, status FROM al WHERE status = 'UnProven' AND pid NOT IN (SELECT 'u' || src FROM tc WHERE src = dst)", recursive=True)
def alarm_filter_rec(spark, sf_dir):
    """Unproven alarms outside recursive procedures."""
    recursive = components.cyclic_nodes(calls(spark, sf_dir)).select(F.concat(F.lit("u"), "node").alias("pid"))
    return bounds_check(spark, sf_dir).where("status = 'UnProven'").join(recursive, "pid", "left_anti").select("pid", "nid", "loc", "status")


@query(_ALARMS_SQL + """, rk AS (SELECT pid, loc, row_number() OVER (ORDER BY pid, loc) AS rank FROM al WHERE status = 'UnProven' GROUP BY pid, loc)
 SELECT rank, pid, loc, nid, status, 'offset: [' || off_lo || ', ' || off_hi || '], size: [' || size_lo || ', ' || size_hi || ']' AS descr FROM al JOIN rk USING (pid, loc) WHERE status = 'UnProven'""")
def alarm_report(spark, sf_dir):
    """The printed report: unproven locations, numbered, with what is said of each alarm there."""
    found = bounds_check(spark, sf_dir).where("status = 'UnProven'")
    numbers = ranked(found.select("pid", "loc").distinct(), [F.asc("pid"), F.asc("loc")])
    descr = F.concat(F.lit("offset: "), I.text(I.interval("off_lo", "off_hi")), F.lit(", size: "), I.text(I.interval("size_lo", "size_hi")))
    return found.join(numbers, ["pid", "loc"]).select("rank", "pid", "loc", "nid", "status", descr.alias("descr"))


def _weights(spark, sf_dir):
    return accesses(spark, sf_dir).groupBy("pid", "loc").agg(F.count("*").alias("weight"))


_WEIGHT_SQL = _ACCESS_SQL + ", wt AS (SELECT pid, loc, count(*) AS weight FROM ac WHERE kind IS NOT NULL GROUP BY ALL), rk AS (SELECT *, row_number() OVER (ORDER BY weight DESC, pid, loc) AS rank FROM wt)"


@query(_WEIGHT_SQL + " SELECT pid, loc, weight, rank FROM rk")
def rank_locations(spark, sf_dir):
    """Locations by weight, heaviest first."""
    return ranked(_weights(spark, sf_dir), [F.desc("weight"), F.asc("pid"), F.asc("loc")])


@query(_WEIGHT_SQL + " SELECT pid, loc, weight, rank FROM rk WHERE rank <= (SELECT count(*) FROM wt) * 10 // 100")
def rank_top_percent(spark, sf_dir):
    """The heaviest tenth of all locations."""
    return take_top(_weights(spark, sf_dir), [F.desc("weight"), F.asc("pid"), F.asc("loc")], percent=10)


@query(STATES_SQL + " SELECT pid, loc, lo, hi FROM st")
def stream_interval_join(spark, sf_dir):
    """interval_join, kept up to date by a stream."""
    return streamed_states(spark, sf_dir)


@query(_ALARMS_SQL + " SELECT * FROM al")
def json_export(spark, sf_dir):
    """The flagship's rows, exported as JSON and read again."""
    rows = bounds_check(spark, sf_dir)
    return store.load(spark, store.save(rows, "alarms", "json"), rows.schema, "json")


@query(_ALARMS_SQL + " SELECT * FROM al")
def parquet_export(spark, sf_dir):
    """The flagship's rows, saved as Parquet and taken up again."""
    rows = bounds_check(spark, sf_dir)
    return store.load(spark, store.save(rows, "alarms"), rows.schema)


@query(""" SELECT '{"src":' || src || ',"dst":' || dst || '}' AS line FROM edges UNION ALL SELECT DISTINCT '{"node":' || user_id || '}' FROM ev""")
def call_graph_json(spark, sf_dir):
    """The call graph as lines of JSON: a line for each procedure and for each call, so no line grows with the graph; written as text and read again."""
    lines = calls(spark, sf_dir).select(F.to_json(F.struct("src", "dst")).alias("line"))
    nodes = points(spark, sf_dir).select(F.to_json(F.struct(F.col("user_id").alias("node"))).alias("line")).distinct()
    both = lines.unionByName(nodes)
    return store.load(spark, store.save(both, "call-graph", "text"), both.schema, "text")
