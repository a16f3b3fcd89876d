"""Facts as a stream. Only order-free lattices (joins of sets and intervals) are kept up to date, so late facts change nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.graph import shared_dir


def stores(events: DataFrame) -> DataFrame:
    """pid, loc, v of stores; works on tables and streams."""
    loc = F.get_json_object("props", "$.k").cast("int") % 10
    return events.where("event_type = 'purchase'").select(F.concat(F.lit("u"), "user_id").alias("pid"), loc.alias("loc"), F.floor("value").cast("long").alias("v"))


def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, loc, lo, hi of all values stored, by a stream over the events that runs until it has read what is there.

    Each batch writes the groups that it changed under its number; a batch that is run again overwrites its own files.
    Intervals only grow, so the join over the batches is the state.
    """
    path = f"{sf_dir}/events.parquet"
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream takes a lone file only so
    state = stores(events).groupBy("pid", "loc").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(state.schema).parquet(f"{home}/out")
    return written.groupBy("pid", "loc").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
