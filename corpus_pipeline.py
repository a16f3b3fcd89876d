"""A corpus from `documents`: quality classifier, exact dedup, near dedup, source mix, packed sequences.

Every stage takes null and empty texts, null and repeated ids and very long texts, gives no rows for an empty table, and
keeps all columns of its input, whatever their names; the last gives pieces instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm.common import materialize, read_table
from factweave.llm.exact_dedup import exact_dedup
from factweave.llm.mixing import mix
from factweave.llm.near_copies import near_dedup
from factweave.llm.packing import pack
from factweave.llm.perplexity import quality_filter


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted model is within their language's threshold; null and empty texts stay, repeated rows are judged alike."""
    return quality_filter(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z's case (null is empty), the row with the largest doc_id; null ids lose, and of equal ids one row stays."""
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that five-word similarities of 0.8 or more join, the row with the smallest doc_id; null ids lose, and of equal ids one row stays. Texts without words are alike."""
    return near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by the sources' rates, in a global random order; null is a source, and rows of one doc_id have equal counts."""
    return mix(docs).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences of at most 4096 tokens; null and empty texts are one end token, repeated rows are placed each for itself."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", source_mix),
    ("best_fit_packing", sequences),
]

#: SQL expresses neither min-hashes nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
