"""Operator 5: weighted rendezvous sharding.

Every row scores each shard by weight / -ln(u), u a hash of record key and shard in (0, 1), and goes to the best.
A further shard leaves all other scores as they were, so it takes rows only into itself. Places in a shard are
given without sorting a shard in one task: rows are numbered in hash buckets of a shard, and buckets start where
the counts before them end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_to_long, lookup, materialize, read_table, text_of

#: So many 32-bit hashes come from one MD5.
PER_DIGEST = 4


def uniform(key: str, shard: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(str(shard // PER_DIGEST))).cast("binary"))
    return (hex_to_long(F.substring(digest, 1 + 8 * (shard % PER_DIGEST), 8)) + F.lit(0.5)) / F.lit(4294967296.0)


def best_shard(key: str, weights: list[float]) -> Column:
    """The shard with the highest score; ties go to the lower number."""
    scores = [F.struct((F.lit(float(w)) / -F.log(uniform(key, s))).alias("score"), F.lit(-s).alias("no")) for s, w in enumerate(weights)]
    return -F.array_max(F.array(*scores))["no"]


def rendezvous_shards(docs: DataFrame, weights: list[float], *, grown_weight: float = 1.0, key: str = "doc_id", buckets: int = 1024, hot_key: int = 10_000) -> DataFrame:
    """One row per row of `docs`: key, size, text_crc32, shard, slot, grown_shard.

    `shard` is for the shards of `weights`, `grown_shard` for one more of `grown_weight`. Null keys are one key; a null
    text has no bytes (size 8, checksum 0). Rows repeated under one key share its shard and get slots of their own; a
    key with more than `hot_key` rows is numbered by input partition as well, so it doesn't fill one task. Texts of
    any length count whole. Other columns, whatever their names, are left out; `key` must not have one of the result's names.
    An empty table gives no rows.
    """
    if not weights or min(weights) <= 0 or grown_weight <= 0:
        raise ValueError("weights: at least one, all above 0")
    text, n = text_of(), len(weights)
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary"))
    rows = materialize(
        docs.select(
            F.col(key), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            best_shard(key, weights).cast("int").alias("shard"), best_shard(key, [*weights, grown_weight]).cast("int").alias("grown_shard"),
            F.pmod(hex_to_long(F.substring(hashed, 1, 8)), F.lit(buckets)).cast("int").alias("bucket"), F.spark_partition_id().alias("at"),
        ),
        "sharding",
    )
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select(key, F.lit(True).alias("hot"))
    if hot.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        rows = lookup(rows, hot, [key], F.struct(key, "at")).withColumn("part", F.when(F.col("hot"), F.pmod("at", F.lit(256))).otherwise(0)).drop("hot")
    counts = rows.groupBy("shard", "bucket", "part").agg(F.count("*").alias("n"))
    # at most n * buckets rows, and 256 more for each hot key's bucket
    starts = counts.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("shard", "bucket", "part", F.coalesce("first", F.lit(0)).alias("first"))
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "bucket", "part").orderBy(F.col(key), "size", "text_crc32")))
    placed = lookup(placed, starts, ["shard", "bucket", "part"], F.col(key), bound=max(200_000, 2 * n * buckets))
    return placed.select(key, "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")


def op5_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    out = rendezvous_shards(read_table(spark, sf_dir, "documents"), [1.0] * 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
