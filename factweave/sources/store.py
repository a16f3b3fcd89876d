"""Saved results: Parquet to resume from, JSON to hand on. Paths are in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from factweave.operators.graph import shared_dir
from factweave.sources.events import CALLS_SQL

#: Where a query's own SQL begins, after the shared views.
AFTER_VIEWS = CALLS_SQL


def save(df: DataFrame, name: str, form: str = "parquet") -> str:
    """Writes all rows; returns the path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.{form}"
    df.write.format(form).save(path)
    return path


def load(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).schema(schema).load(path)
