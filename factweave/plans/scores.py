"""Scores of vectors, paths with their nodes, and sets with a top."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.kernels import rbf_decision
from factweave.operators import cosets, graph
from factweave.plans.catalog import query
from factweave.sources.events import calls, points

#: Fixed values of the one-class model: how many support vectors (those of the smallest ids), gamma, offset.
SUPPORT, GAMMA, OFFSET = 16, 0.5, 0.45


@query(f""", good AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), sv AS (SELECT vec_id AS sid, e AS s FROM good ORDER BY vec_id LIMIT {SUPPORT})
 SELECT vec_id, round(score, 6) AS score, score >= 0 AS inside FROM (SELECT vec_id, sum(exp(-{GAMMA} * list_sum(list_transform(list_zip(e, s), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) / {SUPPORT} - {OFFSET} AS score FROM good, sv GROUP BY vec_id)""")
def ocsvm_score(spark, sf_dir):
    """One-class decision of every vector against a fixed number of support vectors, which go into the plan as constants."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").select("vec_id", "embedding")
    support = [r.embedding for r in rows.orderBy("vec_id").limit(SUPPORT).collect()]
    score = rbf_decision(F.col("embedding"), support, [1 / SUPPORT] * len(support), GAMMA, OFFSET)
    return rows.withColumn("score", score).select("vec_id", F.round("score", 6).alias("score"), (F.col("score") >= 0).alias("inside"))


@query(""", w AS (SELECT 0::BIGINT AS node, 0::BIGINT AS dist UNION SELECT e.dst, dist + 1 FROM w JOIN edges e ON node = e.src WHERE dist < (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges))),
 ds AS (SELECT node, min(dist) AS dist FROM w GROUP BY node), up AS (SELECT e.dst AS node, min(e.src) AS up FROM edges e JOIN ds a ON a.node = e.src JOIN ds b ON b.node = e.dst WHERE a.dist = b.dist - 1 GROUP BY e.dst),
 pt AS (SELECT node, dist AS step, node AS via FROM ds UNION ALL SELECT pt.node, step - 1, up.up FROM pt JOIN up ON up.node = pt.via)
 SELECT node, step, via FROM pt""", recursive=True)
def shortest_path(spark, sf_dir):
    """The procedures on a shortest chain of calls from procedure 0 to each that it reaches."""
    return graph.shortest_paths(calls(spark, sf_dir), spark.range(1).select(F.col("id").alias("node")))


#: The values 0 to 9 that programs list, and 99 for all others.
_COSETS_SQL = """, base AS (SELECT DISTINCT user_id AS key FROM ev), u AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 99]) AS elem),
 lx AS (SELECT DISTINCT user_id AS key, loc AS elem FROM ev WHERE event_type = 'purchase' AND user_id % 7 <> 0 AND loc % 3 = user_id % 3), ly AS (SELECT DISTINCT user_id AS key, loc AS elem FROM ev WHERE event_type = 'view' AND user_id % 5 <> 0 AND loc % 3 = user_id % 3),
 mb AS (SELECT key, elem, (key % 2 = 0) <> EXISTS (SELECT * FROM lx WHERE lx.key = base.key AND lx.elem = u.elem) AS x, (key % 3 = 0) <> EXISTS (SELECT * FROM ly WHERE ly.key = base.key AND ly.elem = u.elem) AS y FROM base, u)"""


def _listed_sql(op: str) -> str:
    return _COSETS_SQL + f""", r AS (SELECT key, elem, {op} AS here FROM mb) SELECT key, CASE WHEN elem <> 99 THEN elem END AS elem FROM r
 WHERE CASE WHEN elem = 99 THEN here ELSE here <> (SELECT o.here FROM r o WHERE o.key = r.key AND o.elem = 99) END"""


def _cosets(spark, sf_dir):
    """A procedure's purchased locations and its viewed ones (of its third of all), or all but those for every second and third; bottoms and tops among them."""
    rows = points(spark, sf_dir).where("loc % 3 = user_id % 3")
    keys = points(spark, sf_dir).select(F.col("user_id").alias("key")).distinct()
    sides = []
    for kind, empty, every in (("purchase", 7, 2), ("view", 5, 3)):
        listed = rows.where((F.col("event_type") == kind) & (F.col("user_id") % empty != 0)).select(F.col("user_id").alias("key"), F.col("loc").alias("elem")).distinct()
        sides.append(listed.unionByName(keys.where(F.col("key") % every == 0).withColumn("elem", F.lit(None).cast("int"))))
    return sides


@query(_listed_sql("x OR y"))
def coset_join(spark, sf_dir):
    return cosets.join(*_cosets(spark, sf_dir))


@query(_listed_sql("x AND y"))
def coset_meet(spark, sf_dir):
    return cosets.meet(*_cosets(spark, sf_dir))


@query(_COSETS_SQL + " SELECT key, NOT bool_or(x AND NOT y) AS is_le FROM mb WHERE EXISTS (SELECT * FROM lx WHERE lx.key = mb.key) OR EXISTS (SELECT * FROM ly WHERE ly.key = mb.key) OR key % 2 = 0 OR key % 3 = 0 GROUP BY key")
def coset_le(spark, sf_dir):
    """Whether one set lies in the other, for procedures of which either has rows."""
    return cosets.le(*_cosets(spark, sf_dir))
