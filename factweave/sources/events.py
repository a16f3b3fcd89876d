"""Program facts from the `events` table: each user is a procedure, each event a program point.

signup allocates `v` cells at location k % 10, purchase stores v there, view reads there at offset v, click assumes
that it is at most v, and error with k < 8 calls another procedure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, nid (from 1, in time), event_type, k, loc, v, user_id."""
    k = F.get_json_object("props", "$.k").cast("int")
    nid = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), "user_id").alias("pid"), nid.alias("nid"), "event_type", k.alias("k"), F.floor("value").cast("long").alias("v"), "user_id")
    return rows.withColumn("loc", F.col("k") % 10)


def owned(points: DataFrame) -> DataFrame:
    """The points, with allocations of k >= 50 at locations of their own procedure (1000 + user_id)."""
    return points.withColumn("loc", F.when((F.col("event_type") == "signup") & (F.col("k") >= 50), 1000 + F.col("user_id")).otherwise(F.col("loc")).cast("long"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: distinct call edges between users. The number of users is one row, joined to all."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("user_id").alias("last"))
    errors = events.where("event_type = 'error'").select("user_id", k.alias("k")).where("k < 8").join(F.broadcast(last))
    to = F.when(F.col("k") == 0, F.greatest(F.col("user_id") - 3, F.lit(0).cast("long"))).otherwise(F.least(F.col("user_id") + F.col("k"), F.col("last")))
    return errors.select(F.col("user_id").alias("src"), to.alias("dst")).distinct()


EVENTS_SQL = """ev AS (SELECT 'u' || user_id AS pid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nid, event_type,
  CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) % 10 AS loc, CAST(floor(value) AS BIGINT) AS v, user_id FROM events)"""
CALLS_SQL = """edges AS (SELECT DISTINCT user_id AS src, CASE WHEN k = 0 THEN greatest(user_id - 3, 0) ELSE least(user_id + k, (SELECT max(user_id) FROM events)) END AS dst
  FROM (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) WHERE event_type = 'error' AND k < 8)"""
