"""Operator 4: exact dedup by skew-safe combining.

Copies meet in three steps, each grouping by the whole normalised text beside its digest, so a digest collision
never merges two texts: within a map task (Spark's partial aggregation), within a salt of the digest, and across
the salts. Each step leaves at most one row per text from each of its inputs, so a text that a third of all rows
share costs a task no more than `salts` or its number of map tasks. Verdicts go back to the rows by digest and salt,
never through a list of members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, materialize, salt_of, salts_in, text_of


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dedup_report(docs: DataFrame, *, salts: int = 48, digest=sha256) -> DataFrame:
    """One row per row of `docs` (columns doc_id and text are read; others are ignored).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id
    stays; null ids lose to all others. Rows repeated under the winning doc_id are all marked kept, and if all ids
    of a text are null, all of its rows are. An empty table gives an empty report. `digest` can be any deterministic
    function to binary: weak ones cost speed, not correctness. `salts` is at most 62. Texts of any length are compared whole.
    """
    if not 1 <= salts <= 62:
        raise ValueError("salts: 1 to 62")
    rows = docs.select("doc_id", lower_ascii(text_of()).alias("content")).select(
        "doc_id", "content", digest(F.col("content")).alias("digest"), salt_of(F.col("doc_id"), salts).alias("salt")
    )
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    texts = salted.groupBy("digest", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("seen")
    )
    winners = materialize(
        texts.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("group_size"), F.bit_or("seen").alias("seen"), F.count("*").alias("n_texts")),
        "exact-dedup",
    )
    by_salt = winners.where("n_texts = 1").select(
        F.col("digest").alias("w_digest"), "keep_id", "group_size",
        F.explode(salts_in("seen", salts)).alias("w_salt"),
    )
    keys = rows.select("doc_id", "digest", "salt")
    out = keys.join(by_salt, (F.col("digest") == F.col("w_digest")) & (F.col("salt") == F.col("w_salt")))
    out = out.select("doc_id", "keep_id", "group_size", "digest")
    collided = winners.where("n_texts > 1").select("digest")
    if not collided.isEmpty():  # two texts share a digest: their rows are matched by content
        of_text = salted.join(texts.select("digest", "content", F.col("keep_id").alias("k"), F.col("n").alias("group_size")), ["digest", "content"])
        theirs = rows.join(collided, "digest", "left_semi").join(
            of_text.join(collided, "digest", "left_semi").select("digest", "content", "salt", "k", "group_size"), ["digest", "content", "salt"]
        )
        out = out.unionByName(theirs.select("doc_id", F.col("k").alias("keep_id"), "group_size", "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("digest"))


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of each text, with all its columns: that of the largest doc_id, null before all others, ties by row. Texts are as in dedup_report; columns of any names are kept."""
    row = free_name(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "exact-rows")
    keyed = rows.select(F.struct("doc_id", F.col(row).alias("row")).alias("doc_id"), "text")  # a null id in a struct is less than all others
    kept = dedup_report(keyed, **options).where("kept").select(F.col("doc_id")["row"].alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return dedup_report(read_table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(content) AS text_sha256
FROM t WINDOW g AS (PARTITION BY content)
"""
