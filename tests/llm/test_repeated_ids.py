"""One row of each text, also where ids repeat or are null."""

from factweave.llm import exact_dedup


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(5, "a"), (5, "A"), (5, "b"), (7, "b"), (None, "c"), (None, "c"), (None, "a"), (None, None), (None, ""), (7, "d"), (2, "d")]
    docs = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, row string")
    for digest in (exact_dedup.sha256, lambda c: exact_dedup.F.substring(c.cast("binary"), 1, 0)):
        got = exact_dedup.exact_dedup(docs, digest=digest)
        assert got.columns == docs.columns
        assert sorted(((r.text or "").lower(), r.doc_id or 0) for r in got.collect()) == [("", 0), ("a", 5), ("b", 7), ("c", 0), ("d", 7)]
