"""Graph operators over edge tables (src, dst), iterated by joins; no graph ever reaches the driver.

Each round is written to the shared folder and read back, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds before a fixpoint is given up. Path doubling covers paths of 2 ** ROUNDS edges.
ROUNDS = 64


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir: set it to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table of the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of one edge or more, by path doubling. Only pairs that are new to a round are joined with all found:
    a shortest path begins with one of half its length, rounded up to a power of two, which was new in the round before."""
    now = new = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "closure")
    for _ in range(ROUNDS):
        on = now.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        more = new.join(on, "dst").select("src", F.col("far").alias("dst")).distinct()
        new = cut(more.join(now, ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            return now
        now = now.unionByName(new)
    raise RuntimeError("closure: no fixpoint")


def spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(node, mark columns): the marks of each node and of all that edges lead to from it. Only marks that are new to a node go on, so rows are
    bounded by nodes times marks and no closure is made. Null nodes have no edges. An empty table of marks gives no rows."""
    keys = marks.columns
    links = cut(edges.select("src", F.col("dst").alias("node")).distinct(), "links")
    found = front = cut(marks.distinct(), "marks")
    for step in range(1, 1_000_000):
        new = links.join(front, "node").drop("node").withColumnRenamed("src", "node").select(*keys).distinct()
        front = cut(new.join(found, keys, "left_anti"), "marks")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
        if step % 10 == 0:
            found = cut(found, "found")
    raise RuntimeError("spread: no fixpoint")


def distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, dist): fewest edges from any of `starts` (node); only new nodes go on in a round."""
    links = cut(edges.select("src", "dst").distinct(), "links")
    found = front = cut(starts.select("node").distinct().withColumn("dist", F.lit(0).cast("long")), "front")
    for step in range(1, 1_000_000):
        new = links.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        front = cut(new.withColumn("dist", F.lit(step).cast("long")), "front")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
        if step % 10 == 0:
            found = cut(found, "found")
    raise RuntimeError("distances: no fixpoint")


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, step, via): the nodes of a shortest path from `starts` (node) to each node that they reach, step 0 at a start; of equally short ones, that whose last
    nodes are the smallest. Distances carry their predecessor; paths are then read back from all ends at once."""
    dist = cut(distances(edges, starts), "dist")
    into = edges.select("src", F.col("dst").alias("node")).distinct().join(dist, "node").join(dist.select(F.col("node").alias("src"), F.col("dist").alias("before")), "src")
    up = cut(into.where("before = dist - 1").groupBy("node").agg(F.min("src").alias("up")), "up")
    found = front = cut(dist.select("node", F.col("dist").alias("step"), F.col("node").alias("via")), "path")
    for step in range(1, 1_000_000):
        front = cut(front.join(up.withColumnRenamed("node", "via"), "via").select("node", (F.col("step") - 1).alias("step"), F.col("up").alias("via")), "path")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
        if step % 10 == 0:
            found = cut(found, "found")
    raise RuntimeError("shortest_paths: no end")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return distances(edges, starts).select("node")


def stars(edges: DataFrame, *, salts: int = 8, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (long columns a, b) but the roots; a root is its component's smallest node.

    Rounds end when a round changes nothing. A node's smallest neighbour is found by a combining aggregation, and
    handed to its neighbours in `salts` copies, so a hub doesn't fill a task.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both, both.where("b > a"), salts)
        turned = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        small = _to_smallest(turned, turned, salts).unionByName(turned.groupBy("a").agg(F.min("b").alias("b")))
        now = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if found == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = found
    raise RuntimeError(f"components: no end in {most_rounds} rounds")


def _to_smallest(all_edges: DataFrame, moved: DataFrame, salts: int) -> DataFrame:
    """For each edge (a, b) of `moved`: (b, the smallest of a and a's neighbours)."""
    least = all_edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    least = least.select(F.col("a").alias("l_a"), "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("l_salt"))
    on = (F.col("a") == F.col("l_a")) & (F.col("salt") == F.col("l_salt"))
    return moved.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")).join(least, on).select(F.col("b").alias("a"), F.col("least").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges connect it to, whichever way they point."""
    ends = edges.where("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    return nodes.join(stars(ends), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
