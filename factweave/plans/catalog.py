"""The registered analysis queries and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import interval as I
from factweave.operators import components, graph
from factweave.sources.events import CALLS_SQL, EVENTS_SQL, calls, owned, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Thresholds of widening.
THRESHOLDS = [0, 1, 16, 64, 128, 256]


def query(sql: str | None = None, *, recursive: bool = False):
    """Registers a query under its name; `sql` follows the views ev and edges."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = f"WITH {'RECURSIVE ' * recursive}{EVENTS_SQL}, {CALLS_SQL}{sql}"
        return function

    return register


def states(spark, sf_dir) -> DataFrame:
    """pid, loc, lo, hi: values stored at each location."""
    return points(spark, sf_dir).where("event_type = 'purchase'").groupBy("pid", "loc").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


STATES_SQL = ", st AS (SELECT pid, loc, min(v) AS lo, max(v) AS hi FROM ev WHERE event_type = 'purchase' GROUP BY ALL)"
SIZES_SQL = ", sz AS (SELECT pid, loc, min(v) AS lo, max(v) AS hi FROM ev WHERE event_type = 'signup' GROUP BY ALL)"
PAIRS_SQL = STATES_SQL + SIZES_SQL + ", pr AS (SELECT pid, loc, st.lo AS a, st.hi AS b, sz.lo AS c, sz.hi AS d FROM st JOIN sz USING (pid, loc))"


def sizes(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).where("event_type = 'signup'").groupBy("pid", "loc").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def pairs(spark, sf_dir) -> tuple[DataFrame, I.Interval, I.Interval]:
    """Stored values beside allocation sizes, by location."""
    both = points(spark, sf_dir).where("event_type in ('purchase', 'signup')").groupBy("pid", "loc").agg(
        *[f(F.when(F.col("event_type") == t, F.col("v"))).alias(c) for t, f, c in (("purchase", F.min, "a"), ("purchase", F.max, "b"), ("signup", F.min, "c"), ("signup", F.max, "d"))]
    )
    return both.where("a is not null and c is not null"), I.interval("a", "b"), I.interval("c", "d")


@query("""SELECT pid, nid, loc, off_lo, off_lo AS off_hi, size_lo, size_hi,
  CASE WHEN size_lo IS NULL THEN 'BotAlarm' WHEN off_lo >= 0 AND off_lo < size_lo THEN 'Proven' ELSE 'UnProven' END AS status
FROM (SELECT pid, nid, loc, event_type, v AS off_lo, min(CASE WHEN event_type = 'signup' THEN v END) OVER w AS size_lo, max(CASE WHEN event_type = 'signup' THEN v END) OVER w AS size_hi
  FROM ev WINDOW w AS (PARTITION BY pid, loc ORDER BY nid ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'view'""")
def bounds_check(spark, sf_dir):
    """Reads whose offset may lie outside the sizes allocated so far."""
    so_far = Window.partitionBy("pid", "loc").orderBy("nid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.when(F.col("event_type") == "signup", F.col("v"))
    rows = points(spark, sf_dir).where("event_type in ('view', 'signup')").withColumn("size_lo", F.min(size).over(so_far)).withColumn("size_hi", F.max(size).over(so_far)).where("event_type = 'view'")
    status = F.when(F.col("size_lo").isNull(), "BotAlarm").when((F.col("v") >= 0) & (F.col("v") < F.col("size_lo")), "Proven").otherwise("UnProven")
    return rows.select("pid", "nid", "loc", F.col("v").alias("off_lo"), F.col("v").alias("off_hi"), "size_lo", "size_hi", status.alias("status"))


@query(STATES_SQL + " SELECT * FROM st")
def interval_join(spark, sf_dir):
    return states(spark, sf_dir)


@query(PAIRS_SQL + " SELECT pid, loc, greatest(a, c) AS lo, least(b, d) AS hi FROM pr WHERE greatest(a, c) <= least(b, d)")
def interval_meet(spark, sf_dir):
    rows, x, y = pairs(spark, sf_dir)
    return rows.select("pid", "loc", *I.meet(x, y).alias()).where("lo is not null")


@query(PAIRS_SQL + """ SELECT pid, loc, a + c AS plus_lo, b + d AS plus_hi, a - d AS minus_lo, b - c AS minus_hi,
  least(a * c, a * d, b * c, b * d) AS times_lo, greatest(a * c, a * d, b * c, b * d) AS times_hi FROM pr""")
def interval_arith(spark, sf_dir):
    rows, x, y = pairs(spark, sf_dir)
    return rows.select("pid", "loc", *[c for n, f in (("plus", I.plus), ("minus", I.minus), ("times", I.times)) for c in f(x, y).alias(f"{n}_lo", f"{n}_hi")])


_OPEN_SQL = PAIRS_SQL + f", op AS (SELECT pid, loc, CAST(CASE WHEN a % 5 = 0 THEN {I.NEG} ELSE a - 100 END AS BIGINT) AS a, CAST(CASE WHEN b % 7 = 0 THEN {I.POS} ELSE b END AS BIGINT) AS b, c % 9 - 4 AS c, c % 9 - 4 + d % 3 AS d FROM pr WHERE loc <> 3 UNION ALL SELECT pid, loc, NULL, NULL, c, d FROM pr WHERE loc = 3)"


def open_pairs(spark, sf_dir) -> tuple[DataFrame, I.Interval, I.Interval]:
    """pairs() with infinite bounds, divisors of both signs, and bottom at location 3."""
    rows, _, _ = pairs(spark, sf_dir)
    there = F.col("loc") != 3
    a, b = F.when(F.col("a") % 5 == 0, F.lit(I.NEG)).otherwise(F.col("a") - 100), F.when(F.col("b") % 7 == 0, F.lit(I.POS)).otherwise(F.col("b"))
    low = F.col("c") % 9 - 4
    rows = rows.select("pid", "loc", F.when(there, a).alias("a"), F.when(there, b).alias("b"), F.when(there, low).otherwise(F.col("c")).alias("c"), F.when(there, low + F.col("d") % 3).otherwise(F.col("d")).alias("d"))
    return rows, I.interval("a", "b"), I.interval("c", "d")


def _over(x: str, y: str) -> str:
    return f"CASE WHEN {x} = {I.NEG} THEN CASE WHEN {y} > 0 THEN {I.NEG} ELSE {I.POS} END WHEN {x} = {I.POS} THEN CASE WHEN {y} > 0 THEN {I.POS} ELSE {I.NEG} END ELSE {x} // nullif({y}, 0) END"


_FOUR = ", ".join(_over(x, y) for x in "ab" for y in "cd")


@query(_OPEN_SQL + f""" SELECT pid, loc, CAST(CASE WHEN a IS NULL THEN NULL WHEN c <= 0 AND d >= 0 THEN {I.NEG} ELSE least({_FOUR}) END AS BIGINT) AS lo,
  CAST(CASE WHEN a IS NULL THEN NULL WHEN c <= 0 AND d >= 0 THEN {I.POS} ELSE greatest({_FOUR}) END AS BIGINT) AS hi FROM op""")
def interval_divide(spark, sf_dir):
    """Quotients of intervals with infinite bounds, negative divisors, divisors that may be zero, and bottom."""
    rows, x, y = open_pairs(spark, sf_dir)
    return rows.select("pid", "loc", *I.divide(x, y).alias())


_PRUNED = {
    "lt": ("a", f"least(b, d - 1)"), "le": ("a", "least(b, d)"), "gt": ("greatest(a, c + 1)", "b"), "ge": ("greatest(a, c)", "b"), "eq": ("greatest(a, c)", "least(b, d)"),
    "ne": ("CASE WHEN c = d AND a = c THEN a + 1 ELSE a END", "CASE WHEN c = d AND b = d THEN b - 1 ELSE b END"),
}


@query(_OPEN_SQL + " " + " UNION ALL ".join(f"SELECT pid, loc, '{o}' AS op, {lo} AS lo, {hi} AS hi FROM op WHERE a IS NOT NULL AND {lo} <= {hi}" for o, (lo, hi) in _PRUNED.items()))
def interval_prune_all(spark, sf_dir):
    """Every form of pruning, on intervals with infinite bounds and bottom."""
    rows, x, y = open_pairs(spark, sf_dir)
    forms = F.array(*[F.struct(F.lit(o).alias("op"), *I.prune(o, x, y).alias()) for o in _PRUNED])
    return rows.select("pid", "loc", F.explode(forms).alias("p")).select("pid", "loc", "p.op", "p.lo", "p.hi").where("lo is not null")


_SURE = {"lt": ("b < c", "a >= d"), "le": ("b <= c", "a > d"), "gt": ("a > d", "b <= c"), "ge": ("a >= d", "b < c"), "eq": ("a = b AND c = d AND a = c", "b < c OR d < a"), "ne": ("b < c OR d < a", "a = b AND c = d AND a = c")}


@query(PAIRS_SQL + " SELECT pid, loc, " + ", ".join(f"CAST(CASE WHEN {s} THEN 1 ELSE 0 END AS BIGINT) AS {o}_lo, CAST(CASE WHEN {n} THEN 0 ELSE 1 END AS BIGINT) AS {o}_hi" for o, (s, n) in _SURE.items()) + " FROM pr")
def interval_compare(spark, sf_dir):
    rows, x, y = pairs(spark, sf_dir)
    return rows.select("pid", "loc", *[c for op in _SURE for c in I.compare(op, x, y).alias(f"{op}_lo", f"{op}_hi")])


_DOWN = f"coalesce((SELECT max(t) FROM (SELECT unnest({THRESHOLDS}) AS t) WHERE t <= c), {I.NEG})"
_UP = f"coalesce((SELECT min(t) FROM (SELECT unnest({THRESHOLDS}) AS t) WHERE t >= d), {I.POS})"


@query(PAIRS_SQL + f" SELECT pid, loc, CAST(CASE WHEN c < a THEN {_DOWN} ELSE a END AS BIGINT) AS lo, CAST(CASE WHEN d > b THEN {_UP} ELSE b END AS BIGINT) AS hi FROM pr")
def interval_widen(spark, sf_dir):
    rows, x, y = pairs(spark, sf_dir)
    return rows.select("pid", "loc", *I.widen(x, y, THRESHOLDS).alias())


@query(PAIRS_SQL + f", wd AS (SELECT *, CAST(CASE WHEN c < a THEN {_DOWN} ELSE a END AS BIGINT) AS lo, CAST(CASE WHEN d > b THEN {_UP} ELSE b END AS BIGINT) AS hi FROM pr)"
       f" SELECT pid, loc, CASE WHEN lo = {I.NEG} OR lo IN {tuple(THRESHOLDS)} THEN least(a, c) ELSE lo END AS lo, CASE WHEN hi = {I.POS} OR hi IN {tuple(THRESHOLDS)} THEN greatest(b, d) ELSE hi END AS hi FROM wd")  # fmt: skip
def interval_narrow(spark, sf_dir):
    """What widening gained, narrowed again to the join."""
    rows, x, y = pairs(spark, sf_dir)
    return rows.select("pid", "loc", *I.narrow(I.widen(x, y, THRESHOLDS), I.join(x, y), THRESHOLDS).alias())


@query(PAIRS_SQL + " SELECT pid, loc, a AS lo, least(b, d - 1) AS hi FROM pr WHERE a <= least(b, d - 1)")
def interval_prune(spark, sf_dir):
    """Stored values that can be less than a size."""
    rows, x, y = pairs(spark, sf_dir)
    return rows.select("pid", "loc", *I.prune("lt", x, y).alias()).where("lo is not null")


def _sets(spark, sf_dir):
    kinds = lambda t: F.array_sort(F.collect_set(F.when(F.col("event_type") == t, F.col("k") % 10)))
    return points(spark, sf_dir).groupBy("pid").agg(kinds("purchase").alias("x"), kinds("view").alias("y"))


_SETS_SQL = """, x AS (SELECT DISTINCT pid, loc FROM ev WHERE event_type = 'purchase'), y AS (SELECT DISTINCT pid, loc FROM ev WHERE event_type = 'view'), p AS (SELECT DISTINCT pid FROM ev)
 SELECT pid, coalesce(string_agg(loc::VARCHAR, ',' ORDER BY loc), '') AS locs FROM p LEFT JOIN ({}) USING (pid) GROUP BY pid"""


def _listed(rows, value):
    return rows.select("pid", F.array_join(F.transform(F.array_sort(value), lambda v: v.cast("string")), ",").alias("locs"))


@query(_SETS_SQL.format("SELECT * FROM x UNION SELECT * FROM y"))
def powerset_union(spark, sf_dir):
    return _listed(_sets(spark, sf_dir), F.array_union("x", "y"))


@query(_SETS_SQL.format("SELECT * FROM x INTERSECT SELECT * FROM y"))
def powerset_inter(spark, sf_dir):
    return _listed(_sets(spark, sf_dir), F.array_intersect("x", "y"))


@query(_SETS_SQL.format("SELECT * FROM x EXCEPT SELECT * FROM y"))
def powerset_diff(spark, sf_dir):
    return _listed(_sets(spark, sf_dir), F.array_except("x", "y"))


@query(STATES_SQL + SIZES_SQL + " SELECT pid, loc, min(lo) AS lo, max(hi) AS hi FROM (SELECT * FROM st UNION ALL SELECT * FROM sz) GROUP BY pid, loc")
def map_join(spark, sf_dir):
    return states(spark, sf_dir).unionByName(sizes(spark, sf_dir)).groupBy("pid", "loc").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query(STATES_SQL + SIZES_SQL + """ SELECT pid, loc, st.lo AS old_lo, st.hi AS old_hi, sz.lo AS new_lo, sz.hi AS new_hi FROM st FULL JOIN sz USING (pid, loc)
  WHERE st.lo IS NULL OR (sz.lo IS NOT NULL AND (sz.lo < st.lo OR sz.hi > st.hi))""")
def map_unstables(spark, sf_dir):
    """Locations whose new value isn't in the old one."""
    new = sizes(spark, sf_dir).select("pid", "loc", F.col("lo").alias("new_lo"), F.col("hi").alias("new_hi"))
    rows = states(spark, sf_dir).select("pid", "loc", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi")).join(new, ["pid", "loc"], "full")
    return rows.where(~I.le(I.interval("new_lo", "new_hi"), I.interval("old_lo", "old_hi")))


@query(" SELECT pid, loc, arg_max(v, nid) AS v FROM ev WHERE event_type = 'purchase' GROUP BY pid, loc")
def strong_update(spark, sf_dir):
    return points(spark, sf_dir).where("event_type = 'purchase'").groupBy("pid", "loc").agg(F.max_by("v", "nid").alias("v"))


@query(""" SELECT pid, nid, loc, min(v) OVER w AS lo, max(v) OVER w AS hi FROM ev WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY pid, loc ORDER BY nid ROWS UNBOUNDED PRECEDING)""")
def weak_update(spark, sf_dir):
    w = Window.partitionBy("pid", "loc").orderBy("nid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points(spark, sf_dir).where("event_type = 'purchase'").select("pid", "nid", "loc", F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))


@query(" SELECT src, dst FROM edges")
def call_edges(spark, sf_dir):
    return calls(spark, sf_dir)


_CLOSURE_SQL = ", tc AS (SELECT src, dst FROM edges UNION SELECT tc.src, e.dst FROM tc JOIN edges e ON tc.dst = e.src)"


@query(_CLOSURE_SQL + " SELECT src, dst FROM tc", recursive=True)
def call_closure(spark, sf_dir):
    return graph.closure(calls(spark, sf_dir))


@query(_CLOSURE_SQL + " SELECT src AS proc FROM tc WHERE src = dst", recursive=True)
def is_recursive(spark, sf_dir):
    return components.cyclic_nodes(calls(spark, sf_dir)).select(F.col("node").alias("proc"))


@query(_CLOSURE_SQL + " SELECT src AS proc FROM tc GROUP BY src HAVING count(*) = 1", recursive=True)
def leaf_procs(spark, sf_dir):
    """Procedures with exactly one transitive callee: one callee, which calls nothing but itself."""
    edges = calls(spark, sf_dir)
    one = edges.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("n"))
    last = edges.where("src <> dst").select(F.col("src").alias("dst")).distinct()
    return one.where("n = 1").join(last, "dst", "left_anti").select(F.col("src").alias("proc")).unionByName(one.where("n = 1 and src = dst").select(F.col("src").alias("proc"))).distinct()


_REACH_SQL = ", r AS (SELECT 0::BIGINT AS node UNION SELECT e.dst FROM r JOIN edges e ON r.node = e.src)"


@query(_REACH_SQL + " SELECT DISTINCT user_id AS proc FROM ev WHERE user_id NOT IN (SELECT node FROM r)", recursive=True)
def unreachable_procs(spark, sf_dir):
    start = spark.range(1).select(F.col("id").alias("node"))
    found = graph.reachable(calls(spark, sf_dir), start).withColumnRenamed("node", "proc")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("proc")).distinct().join(found, "proc", "left_anti")


@query(""", b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), c AS (SELECT src AS node, src AS other FROM b UNION SELECT c.node, b.dst FROM c JOIN b ON c.other = b.src)
 SELECT node, min(other) AS component FROM c GROUP BY node""", recursive=True)
def connected_components(spark, sf_dir):
    return graph.components(calls(spark, sf_dir))


@query(_CLOSURE_SQL + """, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
 SELECT node, least(node, coalesce((SELECT min(a.dst) FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node), node)) AS scc FROM n""", recursive=True)
def scc(spark, sf_dir):
    return components.strong_components(calls(spark, sf_dir))


@query(""", w AS (SELECT 0::BIGINT AS node, 0::BIGINT AS dist UNION SELECT e.dst, dist + 1 FROM w JOIN edges e ON node = e.src WHERE dist < (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)))
 SELECT node, min(dist) AS dist FROM w GROUP BY node""", recursive=True)
def shortest_path_len(spark, sf_dir):
    """Fewest calls from procedure 0."""
    return graph.distances(calls(spark, sf_dir), spark.range(1).select(F.col("id").alias("node")))


_ACCESS_SQL = ", ac AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 'def' WHEN event_type IN ('view', 'click') THEN 'use' END AS kind FROM ev)"


def accesses(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "def").when(F.col("event_type").isin("view", "click"), "use")
    return points(spark, sf_dir).withColumn("kind", kind).where("kind is not null")


@query(_ACCESS_SQL + " SELECT pid, loc, kind, count(*) AS n FROM ac WHERE kind IS NOT NULL GROUP BY ALL")
def access_proc(spark, sf_dir):
    return accesses(spark, sf_dir).groupBy("pid", "loc", "kind").agg(F.count("*").alias("n"))


_OWNED_SQL = _ACCESS_SQL + ", oc AS (SELECT * REPLACE (CASE WHEN event_type = 'signup' AND k >= 50 THEN 1000 + user_id ELSE loc END AS loc) FROM ac WHERE kind IS NOT NULL)"


@query(_OWNED_SQL + " SELECT loc, min(pid) AS pid FROM (SELECT DISTINCT pid, loc FROM oc) GROUP BY loc HAVING count(*) = 1")
def access_proc_local(spark, sf_dir):
    """Locations that one procedure alone touches."""
    return owned(accesses(spark, sf_dir)).groupBy("loc").agg(F.min("pid").alias("pid"), F.max("pid").alias("last")).where("pid = last").select("loc", "pid")


@query(_CLOSURE_SQL + _ACCESS_SQL + """, own AS (SELECT DISTINCT user_id, loc, kind FROM ac WHERE kind IS NOT NULL), hull AS (SELECT src, dst FROM tc UNION SELECT DISTINCT user_id, user_id FROM ev)
 SELECT DISTINCT src AS proc, loc, kind FROM hull JOIN own ON dst = user_id""", recursive=True)
def access_reach(spark, sf_dir):
    """What a procedure and all that it calls access."""
    return reach(spark, sf_dir, accesses(spark, sf_dir))


def reach(spark, sf_dir, own: DataFrame) -> DataFrame:
    found = graph.spread(calls(spark, sf_dir), own.select(F.col("user_id").alias("node"), "loc", "kind"))
    return found.withColumnRenamed("node", "proc")


@query(_ACCESS_SQL + " SELECT pid, loc, min(nid) AS nid FROM ac WHERE kind = 'def' GROUP BY pid, loc HAVING count(*) = 1")
def single_defs(spark, sf_dir):
    return accesses(spark, sf_dir).where("kind = 'def'").groupBy("pid", "loc").agg(F.min("nid").alias("nid"), F.count("*").alias("n")).where("n = 1").drop("n")


_DUG_SQL = _ACCESS_SQL + """, lu AS (SELECT pid, nid, loc, kind, max(CASE WHEN kind = 'def' THEN nid END) OVER (PARTITION BY pid, loc ORDER BY nid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM ac WHERE kind IS NOT NULL),
 du AS (SELECT pid, src, nid AS dst, loc FROM lu WHERE kind = 'use' AND src IS NOT NULL)"""


def def_use(spark, sf_dir):
    before = Window.partitionBy("pid", "loc").orderBy("nid").rowsBetween(Window.unboundedPreceding, -1)
    rows = accesses(spark, sf_dir).withColumn("src", F.max(F.when(F.col("kind") == "def", F.col("nid"))).over(before))
    return rows.where("kind = 'use' and src is not null").select("pid", "src", F.col("nid").alias("dst"), "loc")


@query(_DUG_SQL + " SELECT pid, src, dst, loc FROM du")
def last_def_use(spark, sf_dir):
    return def_use(spark, sf_dir)


@query(_DUG_SQL + " SELECT pid, count(*) AS n_edges, count(DISTINCT src) AS n_defs, count(DISTINCT loc) AS n_locs FROM du GROUP BY pid")
def dug_stats(spark, sf_dir):
    return def_use(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_defs"), F.count_distinct("loc").alias("n_locs"))


@query(""" SELECT pid, nid, loc, v, CASE WHEN lo IS NULL THEN 'BotAlarm' WHEN lo > 0 OR hi < 0 THEN 'Proven' ELSE 'UnProven' END AS status FROM
 (SELECT *, min(CASE WHEN event_type = 'purchase' THEN v % 7 END) OVER w AS lo, max(CASE WHEN event_type = 'purchase' THEN v % 7 END) OVER w AS hi FROM ev
  WINDOW w AS (PARTITION BY pid, loc ORDER BY nid ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'click'""")
def div_zero_check(spark, sf_dir):
    """Divisions by what is stored, modulo 7: may it be zero?"""
    so_far = Window.partitionBy("pid", "loc").orderBy("nid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stored = F.when(F.col("event_type") == "purchase", F.col("v") % 7)
    rows = points(spark, sf_dir).where("event_type in ('click', 'purchase')").withColumn("lo", F.min(stored).over(so_far)).withColumn("hi", F.max(stored).over(so_far)).where("event_type = 'click'")
    status = F.when(F.col("lo").isNull(), "BotAlarm").when((F.col("lo") > 0) | (F.col("hi") < 0), "Proven").otherwise("UnProven")
    return rows.select("pid", "nid", "loc", "v", status.alias("status"))


def _oracle_of(name):
    return ORACLES[name].split("SELECT pid, nid, loc, off_lo", 1)


_ALARMS_SQL = ", al AS (SELECT pid, nid, loc, off_lo" + _oracle_of("bounds_check")[1] + ")"


@query(_ALARMS_SQL + """ SELECT CAST(sum(n) AS BIGINT) AS n_queries, count(*) AS n_points, count(*) FILTER (NOT unproven) AS n_proven, count(*) FILTER (unproven) AS n_unproven, count(*) FILTER (bot) AS n_bot
 FROM (SELECT count(*) AS n, bool_or(status = 'UnProven') AS unproven, bool_or(status = 'BotAlarm') AS bot FROM al GROUP BY pid, loc)""")
def alarm_summary(spark, sf_dir):
    """Queries, and the points (locations) they are at: without an unproven query, with one, with one on bottom."""
    any_of = lambda s: F.bool_or(F.col("status") == s)
    at = bounds_check(spark, sf_dir).groupBy("pid", "loc").agg(F.count("*").alias("n"), any_of("UnProven").alias("unproven"), any_of("BotAlarm").alias("bot"))
    return at.agg(F.sum("n").alias("n_queries"), F.count("*").alias("n_points"), F.count_if(~F.col("unproven")).alias("n_proven"), F.count_if("unproven").alias("n_unproven"), F.count_if("bot").alias("n_bot"))


@query(_ALARMS_SQL + " SELECT pid, loc, count(*) AS n, CASE WHEN bool_or(status = 'BotAlarm') THEN 'BotAlarm' WHEN bool_or(status = 'UnProven') THEN 'UnProven' ELSE 'Proven' END AS status FROM al GROUP BY pid, loc")
def alarm_partition(spark, sf_dir):
    """Alarms of a location as one: bottom if any is, else unproven if any is."""
    any_of = lambda s: F.bool_or(F.col("status") == s)
    return bounds_check(spark, sf_dir).groupBy("pid", "loc").agg(F.count("*").alias("n"), F.when(any_of("BotAlarm"), "BotAlarm").when(any_of("UnProven"), "UnProven").otherwise("Proven").alias("status"))


@query(_CLOSURE_SQL + """, src AS (SELECT user_id, loc FROM ev WHERE event_type = 'view' AND v > 250), hull AS (SELECT src, dst FROM tc UNION SELECT DISTINCT user_id, user_id FROM ev)
 SELECT hull.src AS proc, count(DISTINCT user_id * 10 + loc) AS n_sources FROM hull JOIN src ON dst = user_id GROUP BY 1""", recursive=True)
def taint_sources(spark, sf_dir):
    """How many tainted locations reach a procedure through what it calls."""
    own = points(spark, sf_dir).where("event_type = 'view' and v > 250").select(F.col("user_id").alias("node"), (F.col("user_id") * 10 + F.col("loc")).alias("source"))
    return graph.spread(calls(spark, sf_dir), own).groupBy(F.col("node").alias("proc")).agg(F.count("*").alias("n_sources"))


@query(" SELECT pid, event_type, n, round(n::DOUBLE / max(n) OVER (PARTITION BY event_type), 6) AS share FROM (SELECT pid, event_type, count(*) AS n FROM ev GROUP BY ALL)")
def feature_normalize(spark, sf_dir):
    """A procedure's events of each kind over the most that any has; the few maxima are joined, so no window holds a kind."""
    n = points(spark, sf_dir).groupBy("pid", "event_type").agg(F.count("*").alias("n"))
    most = n.groupBy("event_type").agg(F.max("n").alias("most"))
    return n.join(most, "event_type").select("pid", "event_type", "n", F.round(F.col("n") / F.col("most"), 6).alias("share"))


def _all() -> None:
    """Modules that register further queries."""
    from factweave.plans import expressions, features, flow, lattice, reports, scores, tops  # noqa: F401


def queries() -> dict:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(ORACLES)
