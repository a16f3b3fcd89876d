"""Flow graphs and loops from the `events` table, as facts for the operators on flow graphs.

A procedure's points follow each other in time, from an entry before the first (number 0). A click with k < 50 may also
branch over the next 1 + k % 5 points, an error with k >= 80 back over the last 1 + k % 7. Node numbers are
user_id * 1000000 + nid. Purchases and signups define their location, views and clicks use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.sources.events import points

#: Points of a procedure at most.
SPAN = 1_000_000


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), distinct."""
    rows = points(spark, sf_dir).withColumn("n", F.max("nid").over(Window.partitionBy("user_id"))).withColumn("at", F.col("user_id") * SPAN)
    on, back = F.col("nid") + 2 + F.col("k") % 5, F.greatest(F.col("nid") - 1 - F.col("k") % 7, F.lit(1).cast("long"))
    far = F.when((F.col("event_type") == "click") & (F.col("k") < 50) & (on <= F.col("n")), on).when((F.col("event_type") == "error") & (F.col("k") >= 80), back)
    both = F.array(F.struct((F.col("nid") - 1).alias("s"), F.col("nid").alias("d")), F.struct(F.col("nid").alias("s"), far.alias("d")))
    edges = rows.select("at", F.explode(both).alias("e")).where("e.d is not null")
    return edges.select((F.col("at") + F.col("e.s")).alias("src"), (F.col("at") + F.col("e.d")).alias("dst")).distinct()


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") * SPAN).alias("node")).distinct()


def flow_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, loc, kind): kind is def or use."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "def").when(F.col("event_type").isin("view", "click"), "use")
    return points(spark, sf_dir).select((F.col("user_id") * SPAN + F.col("nid")).alias("node"), "loc", kind.alias("kind")).where("kind is not null")


#: Nodes of a counting loop, in the order of their numbers.
LOOP = ("init", "head", "body", "step", "exit")


def counting_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, loc, a, b, c, s): a location's loop, `x = [a, b]; while (x < c) x = x + s`, from its purchases, its last click by value and its lowest view."""
    of = lambda t, e: F.when(F.col("event_type") == t, e)
    rows = points(spark, sf_dir).groupBy("user_id", "loc").agg(
        F.min(of("purchase", F.col("v") % 50)).alias("a"), F.max(of("purchase", F.col("v") % 50)).alias("b"), F.max(of("click", F.col("v"))).alias("c"), F.min(of("view", F.col("k") % 3 + 1)).cast("long").alias("s")
    )
    return rows.where("a is not null and c is not null and s is not null")


def loop_facts(loops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Def-use edges (src, dst, loc) and commands of counting loops; node numbers are ((user_id * 10 + loc) * 10 + place in LOOP)."""
    at = lambda name: (F.col("user_id") * 10 + F.col("loc")) * 10 + LOOP.index(name)
    x, none = F.lit("x"), F.lit(None).cast("long")
    edges = loops.select(F.explode(F.array(*[F.struct(at(s).alias("src"), at(d).alias("dst"), x.alias("loc")) for s, d in (("init", "head"), ("step", "head"), ("head", "body"), ("body", "step"), ("head", "exit"))])).alias("e")).select("e.*")
    command = lambda node, op, x_loc, lo, hi, y: F.struct(at(node).alias("node"), x.alias("loc"), F.lit(op).alias("op"), x_loc.alias("x_loc"), lo.alias("x_lo"), hi.alias("x_hi"), F.lit(None).cast("string").alias("y_loc"), y.alias("y_lo"), y.alias("y_hi"), F.lit(False).alias("weak"))
    made = [
        command("init", "copy", F.lit(None).cast("string"), F.col("a"), F.col("b"), none), command("body", "lt", x, none, none, F.col("c")),
        command("step", "plus", x, none, none, F.col("s")), command("exit", "ge", x, none, none, F.col("c")),
    ]
    return edges, loops.select(F.explode(F.array(*made)).alias("c")).select("c.*")


FLOW_SQL = f""", cf AS (SELECT user_id * {SPAN} + nid - 1 AS src, user_id * {SPAN} + nid AS dst FROM ev
 UNION SELECT user_id * {SPAN} + nid, user_id * {SPAN} + nid + 2 + k % 5 FROM (SELECT *, max(nid) OVER (PARTITION BY user_id) AS n FROM ev) WHERE event_type = 'click' AND k < 50 AND nid + 2 + k % 5 <= n
 UNION SELECT user_id * {SPAN} + nid, user_id * {SPAN} + greatest(nid - 1 - k % 7, 1) FROM ev WHERE event_type = 'error' AND k >= 80),
 nd AS (SELECT user_id, user_id * {SPAN} AS node FROM ev UNION SELECT user_id, user_id * {SPAN} + nid FROM ev)"""

#: Dominators by what stays reachable without a node.
DOMINATORS_SQL = FLOW_SQL + f""", rw AS (SELECT node AS d, user_id * {SPAN} AS n FROM nd WHERE node <> user_id * {SPAN} UNION SELECT rw.d, cf.dst FROM rw JOIN cf ON rw.n = cf.src WHERE cf.dst <> rw.d),
 sd AS (SELECT a.node AS d, b.node AS n FROM nd a JOIN nd b USING (user_id) WHERE a.node <> b.node AND NOT EXISTS (SELECT * FROM rw WHERE rw.d = a.node AND rw.n = b.node)),
 dp AS (SELECT n, count(*) AS depth FROM sd GROUP BY n)"""

FRONTIERS_SQL = DOMINATORS_SQL + """, fr AS (SELECT DISTINCT w.d AS x, cf.dst AS y FROM cf JOIN (SELECT d, n FROM sd UNION ALL SELECT node, node FROM nd) w ON w.n = cf.src
   WHERE NOT EXISTS (SELECT * FROM sd WHERE sd.d = w.d AND sd.n = cf.dst))"""

PHI_SQL = FRONTIERS_SQL + f""", fa AS (SELECT user_id * {SPAN} + nid AS node, loc, CASE WHEN event_type IN ('purchase', 'signup') THEN 'def' WHEN event_type IN ('view', 'click') THEN 'use' END AS kind FROM ev),
 ph AS (SELECT y AS node, loc FROM fr JOIN fa ON x = node AND kind = 'def' UNION SELECT y, ph.loc FROM fr JOIN ph ON x = ph.node)"""

DEF_USE_SQL = PHI_SQL + """, dd AS (SELECT node, loc FROM fa WHERE kind = 'def' UNION SELECT node, loc FROM ph),
 ask AS (SELECT node AS dst, loc, node AS n, false AS here FROM fa WHERE kind = 'use' AND NOT EXISTS (SELECT * FROM ph WHERE ph.node = fa.node AND ph.loc = fa.loc)
   UNION ALL SELECT ph.node, loc, cf.src, true FROM ph JOIN cf ON cf.dst = ph.node),
 up AS (SELECT d, n FROM sd),
 du AS (SELECT dst, loc, n, here, arg_max(d, depth) AS src FROM (
   SELECT ask.dst, ask.loc, ask.n, here, up.d, coalesce(dp.depth, 0) AS depth FROM ask JOIN up ON up.n = ask.n JOIN dd ON dd.node = up.d AND dd.loc = ask.loc LEFT JOIN dp ON dp.n = up.d
   UNION ALL SELECT ask.dst, ask.loc, ask.n, here, ask.n, 1000000000 FROM ask JOIN dd ON dd.node = ask.n AND dd.loc = ask.loc WHERE here) GROUP BY dst, loc, n, here)"""

LOOPS_SQL = """, lp AS (SELECT user_id, loc, min(CASE WHEN event_type = 'purchase' THEN v % 50 END) AS a, max(CASE WHEN event_type = 'purchase' THEN v % 50 END) AS b, max(CASE WHEN event_type = 'click' THEN v END) AS c,
   min(CASE WHEN event_type = 'view' THEN k % 3 + 1 END)::BIGINT AS s FROM ev GROUP BY user_id, loc HAVING a IS NOT NULL AND c IS NOT NULL AND s IS NOT NULL),
 lh AS (SELECT *, CASE WHEN a <= c - 1 THEN greatest(b, c - 1 + s) ELSE b END AS h FROM lp)"""
