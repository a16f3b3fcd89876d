"""Iterations written round by round to the shared folder, from which they can go on.

A round's tables are written and read back, so lineage stays short. What a round replaces is deleted once the new
tables and the manifest that names them are there; an iteration that was ended finds the last manifest and goes on
with the round after it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factweave.operators.graph import shared_dir


def _store(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def delete(spark: SparkSession, path: str) -> None:
    store, there = _store(spark, path)
    store.delete(there, True)


def children(spark: SparkSession, path: str) -> list[str]:
    store, there = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(there)] if store.exists(there) else []


def merged(df: DataFrame) -> DataFrame:
    """`df`, to be joined by merging. Spark takes a written table for as small as its compressed files and gathers it in the driver for a broadcast, tens of times larger."""
    return df.hint("merge")


class Rounds:
    """The tables of one iteration, in a folder of its own, or in `home`, from which an earlier run is taken up."""

    def __init__(self, spark: SparkSession, name: str, home: str | None = None) -> None:
        self.spark, self.resumable = spark, home is not None
        self.home = home or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.number, self.paths = 0, {}

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """`df` as a written table."""
        path = f"{self.home}/tables/{label}-{self.number}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                delete(self.spark, path)

    def commit(self, facts: dict | None = None, **tables: DataFrame | list[DataFrame]) -> None:
        """Ends a round whose state is `tables` (written ones) and `facts`; all others of this iteration are deleted."""
        named = {k: [self.paths[id(d)][0] for d in (v if isinstance(v, list) else [v])] for k, v in tables.items()}
        if self.resumable:
            schemas = {k: (v[0] if isinstance(v, list) else v).schema.json() for k, v in tables.items()}
            row = json.dumps({"round": self.number, "tables": named, "schemas": schemas, "facts": facts or {}})
            self.spark.range(1, numPartitions=1).select(F.lit(row).alias("value")).write.text(f"{self.home}/manifests/{self.number:09d}-{uuid.uuid4().hex[:8]}")
        kept = {p for paths in named.values() for p in paths}
        for key, (path, _) in list(self.paths.items()):
            if path not in kept:
                delete(self.spark, path)
                del self.paths[key]
        self.number += 1

    def resumed(self) -> tuple[dict[str, list[DataFrame]], dict] | None:
        """The tables and facts of the last committed round, if there is one; the next round has the number after it."""
        for name in sorted(children(self.spark, f"{self.home}/manifests"), reverse=True) if self.resumable else []:
            folder = f"{self.home}/manifests/{name}"
            if "_SUCCESS" not in children(self.spark, folder):
                continue  # ended while it was written
            found = json.loads(self.spark.read.text(folder).first().value)
            tables = {}
            for label, paths in found["tables"].items():
                schema = StructType.fromJson(json.loads(found["schemas"][label]))
                tables[label] = [self.spark.read.schema(schema).parquet(p) for p in paths]
                self.paths.update({id(d): (p, d) for d, p in zip(tables[label], paths, strict=True)})
            self.number = found["round"] + 1
            return tables, found["facts"]
        return None


