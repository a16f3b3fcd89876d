"""Truth values, shifts, casts and sizes of intervals, equality and widening of maps, and further reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import interval as I
from factweave.operators.fixpoint import fixpoint
from factweave.operators.ranking import ranked
from factweave.plans.catalog import _ALARMS_SQL, SIZES_SQL, STATES_SQL, THRESHOLDS, bounds_check, query, sizes, states
from factweave.sources.events import calls, points

#: Two intervals of small values around zero at each point; the second is bottom at clicks.
_SMALL_SQL = """, sm AS (SELECT pid, nid, CAST(k % 3 - 1 AS BIGINT) AS a, CAST(k % 3 - 1 + v % 3 AS BIGINT) AS b,
  CAST(CASE WHEN event_type <> 'click' THEN v % 4 - 1 END AS BIGINT) AS c, CAST(CASE WHEN event_type <> 'click' THEN v % 4 - 1 + k % 2 END AS BIGINT) AS d FROM ev)"""


def small(spark, sf_dir) -> tuple[DataFrame, I.Interval, I.Interval]:
    x, y = F.col("k") % 3 - 1, F.when(F.col("event_type") != "click", F.col("v") % 4 - 1)
    rows = points(spark, sf_dir).select("pid", "nid", *[e.cast("long").alias(c) for c, e in (("a", x), ("b", x + F.col("v") % 3), ("c", y), ("d", y + F.col("k") % 2))])
    return rows, I.interval("a", "b"), I.interval("c", "d")


_TRUE = {"x": "(a > 0 OR b < 0)", "y": "(c > 0 OR d < 0)"}
_FALSE = {"x": "(a = 0 AND b = 0)", "y": "(c = 0 AND d = 0)"}


@query(_SMALL_SQL + f""" SELECT pid, nid, CASE WHEN c IS NOT NULL THEN CAST({_TRUE['x']} AND {_TRUE['y']} AS BIGINT) END AS and_lo,
  CASE WHEN c IS NOT NULL THEN CAST(NOT ({_FALSE['x']} OR {_FALSE['y']}) AS BIGINT) END AS and_hi, CASE WHEN c IS NOT NULL THEN CAST({_TRUE['x']} OR {_TRUE['y']} AS BIGINT) END AS or_lo,
  CASE WHEN c IS NOT NULL THEN CAST(NOT ({_FALSE['x']} AND {_FALSE['y']}) AS BIGINT) END AS or_hi, CAST({_FALSE['x']} AS BIGINT) AS not_lo, CAST(NOT {_TRUE['x']} AS BIGINT) AS not_hi FROM sm""")
def interval_logic(spark, sf_dir):
    """And, or and not in three values, with bottom."""
    rows, x, y = small(spark, sf_dir)
    return rows.select("pid", "nid", *I.logical_and(x, y).alias("and_lo", "and_hi"), *I.logical_or(x, y).alias("or_lo", "or_hi"), *I.logical_not(x).alias("not_lo", "not_hi"))


@query(_SMALL_SQL + f""" SELECT pid, nid, CASE WHEN a = b AND c = d AND c >= 0 THEN a * (CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END) ELSE {I.NEG} END AS lo,
  CASE WHEN a = b AND c = d AND c >= 0 THEN a * (CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END) ELSE {I.POS} END AS hi FROM sm WHERE c IS NOT NULL""")
def interval_shift(spark, sf_dir):
    rows, x, y = small(spark, sf_dir)
    return rows.where("c is not null").select("pid", "nid", *I.shift_left(x, y).alias())


@query(_SMALL_SQL + """ SELECT pid, nid, CASE WHEN c IS NULL THEN 0 ELSE d - c + 1 END AS height, CASE WHEN c IS NULL THEN 0 ELSE d - c END AS spread,
  CASE WHEN c < 0 AND d > 0 THEN 0 ELSE least(abs(c), abs(d)) END AS abs_lo, greatest(abs(c), abs(d)) AS abs_hi FROM sm""")
def interval_measures(spark, sf_dir):
    """Number of values, spread and absolute values; bottom has none."""
    rows, _, y = small(spark, sf_dir)
    return rows.select("pid", "nid", I.height(y).alias("height"), I.spread_of(y).alias("spread"), *I.absolute(y).alias("abs_lo", "abs_hi"))


_CASTS = {"u_u": ("unsigned int", "unsigned char"), "s_u": ("int", "unsigned int"), "s_s": ("int", "char"), "u_s": ("unsigned char", "char"), "l_i": ("long", "int"), "ul_l": ("unsigned long", "long long"), "l_us": ("long", "unsigned short")}


def _fits_sql(most: int) -> tuple[str, str]:
    return f"CASE WHEN hi <= {most} THEN lo ELSE {I.NEG} END", f"CASE WHEN hi <= {most} THEN hi ELSE {I.POS} END"


_ABS_SQL = "CASE WHEN lo < 0 AND hi > 0 THEN 0 ELSE least(abs(lo), abs(hi)) END", "greatest(abs(lo), abs(hi))"
_CAST_SQL = {"u_u": _fits_sql(255), "s_u": _ABS_SQL, "s_s": _fits_sql(255), "u_s": _fits_sql(255), "l_i": _fits_sql(2147483648), "ul_l": _fits_sql(2147483648), "l_us": _fits_sql(65535), "free_u": _ABS_SQL, "free_s": ("lo", "hi")}


@query(STATES_SQL + ", sh AS (SELECT pid, loc, CASE loc % 3 WHEN 0 THEN 1 WHEN 1 THEN 400 ELSE 9000000 END * (lo - 100) AS lo, CASE loc % 3 WHEN 0 THEN 1 WHEN 1 THEN 400 ELSE 9000000 END * (hi - 100) AS hi FROM st)"
       " SELECT pid, loc, " + ", ".join(f"{lo} AS {name}_lo, {hi} AS {name}_hi" for name, (lo, hi) in _CAST_SQL.items()) + " FROM sh")  # fmt: skip
def interval_cast(spark, sf_dir):
    """Casts between integer types, with and without overflow, of states less 100 and of their multiples."""
    times = F.when(F.col("loc") % 3 == 0, 1).when(F.col("loc") % 3 == 1, 400).otherwise(9_000_000)
    x = I.Interval(times * (F.col("lo") - 100), times * (F.col("hi") - 100))
    found = {name: I.cast(a, b, x) for name, (a, b) in _CASTS.items()}
    found |= {"free_u": I.cast("int", "unsigned char", x, overflow=False), "free_s": I.cast("int", "char", x, overflow=False)}
    return states(spark, sf_dir).select("pid", "loc", *[c for name, value in found.items() for c in value.alias(f"{name}_lo", f"{name}_hi")])


def _both(spark, sf_dir) -> tuple[DataFrame, I.Interval, I.Interval]:
    other = sizes(spark, sf_dir).select("pid", "loc", F.col("lo").alias("c"), F.col("hi").alias("d"))
    return states(spark, sf_dir).join(other, ["pid", "loc"], "full"), I.interval("lo", "hi"), I.interval("c", "d")


_LOW_SQL = STATES_SQL + ", lw AS (SELECT pid, loc, min(v) AS lo, least(max(v), 400) AS hi FROM ev WHERE event_type = 'purchase' AND k < 95 GROUP BY pid, loc)"


@query(_LOW_SQL + " SELECT pid, bool_and(st.lo IS NOT DISTINCT FROM lw.lo AND st.hi IS NOT DISTINCT FROM lw.hi) AS is_eq FROM st FULL JOIN lw USING (pid, loc) GROUP BY pid")
def map_eq(spark, sf_dir):
    """Whether a procedure's map is the same without stores of k >= 95 and with values capped at 400; a missing key is bottom."""
    other = points(spark, sf_dir).where("event_type = 'purchase' and k < 95").groupBy("pid", "loc").agg(F.min("v").alias("c"), F.least(F.max("v"), F.lit(400)).alias("d"))
    rows = states(spark, sf_dir).join(other, ["pid", "loc"], "full")
    return rows.groupBy("pid").agg(F.bool_and(I.eq(I.interval("lo", "hi"), I.interval("c", "d"))).alias("is_eq"))


_T = f"(SELECT unnest({THRESHOLDS}) AS t)"


@query(STATES_SQL + SIZES_SQL + f""", fj AS (SELECT pid, loc, st.lo AS a, st.hi AS b, sz.lo AS c, sz.hi AS d FROM st FULL JOIN sz USING (pid, loc))
 SELECT pid, loc, CASE WHEN a IS NULL THEN c WHEN c IS NULL OR c >= a THEN a ELSE coalesce((SELECT max(t) FROM {_T} WHERE t <= c), {I.NEG}) END AS lo,
  CASE WHEN b IS NULL THEN d WHEN d IS NULL OR d <= b THEN b ELSE coalesce((SELECT min(t) FROM {_T} WHERE t >= d), {I.POS}) END AS hi FROM fj""")
def map_widen(spark, sf_dir):
    """Widening of maps, also of keys that only one has: those keep their value."""
    rows, x, y = _both(spark, sf_dir)
    return rows.select("pid", "loc", *I.widen(x, y, THRESHOLDS).alias())


@query(_ALARMS_SQL + " SELECT pid, loc FROM al GROUP BY pid, loc HAVING NOT bool_or(status = 'UnProven')")
def proved_points(spark, sf_dir):
    """Locations without an unproven query."""
    return bounds_check(spark, sf_dir).groupBy("pid", "loc").agg(F.bool_or(F.col("status") == "UnProven").alias("open")).where("not open").select("pid", "loc")


@query(_ALARMS_SQL + """ SELECT pid, loc, n, row_number() OVER (ORDER BY pid, loc) AS rank FROM (SELECT pid, loc, count(*) AS n FROM al WHERE status = 'UnProven' GROUP BY pid, loc)""")
def numbered_alarms(spark, sf_dir):
    """Unproven locations in the order of a report, numbered from 1."""
    parts = bounds_check(spark, sf_dir).where("status = 'UnProven'").groupBy("pid", "loc").agg(F.count("*").alias("n"))
    return ranked(parts, [F.asc("pid"), F.asc("loc")])


def without_parts(alarms: DataFrame, keys: list[str], *conditions) -> DataFrame:
    """The alarms of partitions (by `keys`) in which no alarm meets any of `conditions`; a hot partition is one row of the join."""
    met = F.lit(False)
    for condition in conditions:
        met = met | F.coalesce(condition, F.lit(False))
    return alarms.join(alarms.where(met).select(*keys).distinct(), keys, "left_anti")


@query(_ALARMS_SQL + """, un AS (SELECT * FROM al WHERE status = 'UnProven')
 SELECT pid, nid, loc, status FROM un WHERE NOT EXISTS (SELECT * FROM un AS o WHERE o.pid = un.pid AND o.loc = un.loc AND (o.pid = 'u0' OR o.loc IN (3, 7) OR o.off_lo > 450))""")
def alarm_filter_parts(spark, sf_dir):
    """Unproven alarms but those of the global procedure (u0), of allocation sites 3 and 7, and of locations with an offset from outside (over 450), by whole partitions."""
    found = bounds_check(spark, sf_dir).where("status = 'UnProven'")
    return without_parts(found, ["pid", "loc"], F.col("pid") == "u0", F.col("loc").isin(3, 7), F.col("off_lo") > 450).select("pid", "nid", "loc", "status")


@query(""", own AS (SELECT user_id AS node, coalesce(max(v) FILTER (event_type = 'purchase'), 0) AS hi FROM ev GROUP BY user_id),
 h AS (SELECT node, hi FROM own UNION SELECT dst, least(hi + 1, 400) FROM h JOIN edges ON node = src)
 SELECT node, 0::BIGINT AS lo, max(hi) AS hi FROM h GROUP BY node""", recursive=True)
def flow_insensitive_fixpoint(spark, sf_dir):
    """Values up to what a procedure stores; its calls pass them on, raised by one and up to 400. Cycles of calls make bounds grow, so those that do are widened to
    a threshold, the limit, and narrowed to the least fixpoint, which SQL finds by trying all values."""
    stored = F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("v"))), F.lit(0).cast("long"))
    start = points(spark, sf_dir).groupBy(F.col("user_id").alias("node")).agg(F.lit(0).cast("long").alias("lo"), stored.alias("hi"))
    flows = calls(spark, sf_dir).select("src", "dst", F.lit(1).alias("add"), F.lit(0).alias("from"), F.lit(400).alias("to"))
    return fixpoint(flows, start, [400], narrowing=1000)
