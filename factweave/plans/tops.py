"""Queries on maps with a top."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import interval as I
from factweave.operators import topmaps
from factweave.plans.catalog import THRESHOLDS, query
from factweave.sources.events import points

#: Both maps of a procedure beside each other: bottoms are absent, flags tell tops.
_MAPS_SQL = """, base AS (SELECT DISTINCT user_id AS key FROM ev), u AS (SELECT unnest(range(10)) AS loc),
 mx AS (SELECT user_id AS key, loc, min(v) AS a, max(v) AS b FROM ev WHERE event_type = 'purchase' AND user_id % 7 <> 1 GROUP BY ALL),
 my AS (SELECT user_id AS key, loc, min(v) AS c, max(v) AS d FROM ev WHERE event_type IN ('purchase', 'signup') AND user_id % 8 <> 2 AND (k < 70 OR event_type = 'purchase') GROUP BY ALL),
 mm AS (SELECT key, loc, a, b, c, d, key % 6 = 0 AS tx, key % 4 = 0 AS ty FROM base CROSS JOIN u LEFT JOIN mx USING (key, loc) LEFT JOIN my USING (key, loc)),
 there AS (SELECT key FROM mx UNION SELECT key FROM my UNION SELECT key FROM base WHERE key % 6 = 0 OR key % 4 = 0)"""


def _maps(spark, sf_dir):
    """A procedure's stores, and its stores and early allocations; every sixth and fourth is top, some are empty."""
    rows = points(spark, sf_dir).withColumn("key", F.col("user_id"))
    keys = rows.select("key").distinct()
    tops = lambda every: keys.where(F.col("key") % every == 0).select("key", F.lit(None).cast("int").alias("loc"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    bounds = lambda r: r.groupBy("key", "loc").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = bounds(rows.where("event_type = 'purchase' and user_id % 7 <> 1"))
    y = bounds(rows.where("event_type in ('purchase', 'signup') and user_id % 8 <> 2 and (k < 70 or event_type = 'purchase')"))
    return x.unionByName(tops(6)), y.unionByName(tops(4))


def _rows_sql(top: str, lo: str, hi: str) -> str:
    return _MAPS_SQL + f""" SELECT DISTINCT key, CAST(CASE WHEN {top} THEN NULL ELSE loc END AS INT) AS loc, CAST(CASE WHEN NOT ({top}) THEN {lo} END AS BIGINT) AS lo, CAST(CASE WHEN NOT ({top}) THEN {hi} END AS BIGINT) AS hi
 FROM mm WHERE {top} OR ({lo} IS NOT NULL AND {lo} <= {hi})"""


def _one_sql(lo: str, hi: str) -> tuple[str, str]:
    return f"CASE WHEN ty THEN a WHEN tx THEN c ELSE {lo} END", f"CASE WHEN ty THEN b WHEN tx THEN d ELSE {hi} END"


@query(_rows_sql("tx OR ty", "least(a, c)", "greatest(b, d)"))
def topmap_join(spark, sf_dir):
    return topmaps.join(*_maps(spark, sf_dir))


@query(_rows_sql("tx AND ty", *_one_sql("CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN greatest(a, c) END", "CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN least(b, d) END")))
def topmap_meet(spark, sf_dir):
    return topmaps.meet(*_maps(spark, sf_dir))


_T = f"(SELECT unnest({THRESHOLDS}) AS t)"
_WIDE = (
    f"CASE WHEN a IS NULL THEN c WHEN c IS NULL OR c >= a THEN a ELSE coalesce((SELECT max(t) FROM {_T} WHERE t <= c), {I.NEG}) END",
    f"CASE WHEN b IS NULL THEN d WHEN d IS NULL OR d <= b THEN b ELSE coalesce((SELECT min(t) FROM {_T} WHERE t >= d), {I.POS}) END",
)


@query(_rows_sql("tx OR ty", *_WIDE))
def topmap_widen(spark, sf_dir):
    return topmaps.widen(*_maps(spark, sf_dir), THRESHOLDS)


@query(_rows_sql("tx", *_WIDE))
def topmap_widen_add(spark, sf_dir):
    """The second map's bindings, without its tops, added to the first by widening."""
    x, y = _maps(spark, sf_dir)
    return topmaps.widen_add(x, y, THRESHOLDS)


@query(_rows_sql("tx", "coalesce(c, a)", "coalesce(d, b)"))
def topmap_add(spark, sf_dir):
    """The second map's bindings put in place of the first's."""
    return topmaps.add(*_maps(spark, sf_dir))


_LOW, _HIGH = f"CASE WHEN a % 2 = 0 THEN {I.NEG} ELSE a END", f"CASE WHEN b % 3 = 0 THEN {I.POS} ELSE b END"
_MET = f"a IS NOT NULL AND c IS NOT NULL AND greatest({_LOW}, c) <= least({_HIGH}, d)"


@query(_rows_sql("tx AND ty", f"CASE WHEN ty THEN {_LOW} WHEN tx THEN c WHEN {_MET} THEN CASE WHEN a % 2 = 0 THEN c ELSE a END END", f"CASE WHEN ty THEN {_HIGH} WHEN tx THEN d WHEN {_MET} THEN CASE WHEN b % 3 = 0 THEN d ELSE b END END"))
def topmap_narrow(spark, sf_dir):
    """The first map, with some bounds made infinite, narrowed by what it shares with the second."""
    x, y = _maps(spark, sf_dir)
    wide = x.withColumns({"lo": F.when(F.col("lo") % 2 == 0, F.lit(I.NEG)).otherwise(F.col("lo")), "hi": F.when(F.col("hi") % 3 == 0, F.lit(I.POS)).otherwise(F.col("hi"))})
    return topmaps.narrow(wide, topmaps.meet(wide, y))


@query(_MAPS_SQL + " SELECT key, bool_and(CASE WHEN ty THEN true WHEN tx THEN false ELSE a IS NULL OR (c IS NOT NULL AND c <= a AND b <= d) END) AS is_le FROM mm JOIN there USING (key) GROUP BY key")
def topmap_le(spark, sf_dir):
    return topmaps.le(*_maps(spark, sf_dir))


@query(_MAPS_SQL + " SELECT key, bool_and(CASE WHEN tx OR ty THEN tx AND ty ELSE a IS NOT DISTINCT FROM c AND b IS NOT DISTINCT FROM d END) AS is_eq FROM mm JOIN there USING (key) GROUP BY key")
def topmap_eq(spark, sf_dir):
    return topmaps.eq(*_maps(spark, sf_dir))
