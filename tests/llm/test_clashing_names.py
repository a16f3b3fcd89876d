"""Columns of the input with names that operators use inside stay as they are, whichever way a lookup goes."""

import pytest
from pyspark.sql import functions as F

from factweave.llm import common, exact_dedup, mixing, near_copies, perplexity, quality_rules

ODD = ["row", "block", "fold", "poisson", "lookup_source", "lookup_salt", "__row", "__salt", "__keep", "__rate", "__table", "__r_source", "__words"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", "en", *[f"{c}{i}" for c in ODD]) for i, t in enumerate(["a b c", "A b c", "d e", None, "d e f g h i", "x y z"])]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", "lang string", *[f"`{c}` string" for c in ODD]]))


def whole(out, docs):
    assert out.select(*docs.columns).columns == docs.columns
    got = out.select("doc_id", *ODD).collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in ODD)


def test_filters(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (exact_dedup.exact_dedup(docs), near_copies.near_dedup(docs), mixing.mix(docs), perplexity.quality_filter(docs, labels)):
        whole(out, docs)


def test_lines(docs):
    whole(quality_rules.clean_lines(docs, keep=docs.columns), docs)
    with pytest.raises(ValueError):
        quality_rules.clean_lines(docs.withColumn("N_words", F.lit(1)), keep=["N_words"])


@pytest.mark.parametrize("limits", [{}, {"bound": 0}, {"most_bytes": 0}])
def test_lookup_gives_equal_columns_both_ways(spark, docs, limits):
    small = spark.createDataFrame([("s", 1), (None, 2)], "source string, got int")
    out = common.lookup(docs, small, ["source"], F.col("doc_id"), **limits)
    assert out.columns == [*docs.columns, "got"] and {r.got for r in out.collect()} == {1}
    whole(out, docs)


def test_repeated_windows_are_compared_word_for_word(spark, monkeypatch):
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.lit(1).cast("long"))  # all hashes collide
    text = " ".join(f"w{i}" for i in range(12))
    rows = spark.createDataFrame([(1, text), (2, text + " . " + text)], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.clean_lines(rows).collect()} == {1: 0, 2: 24}
