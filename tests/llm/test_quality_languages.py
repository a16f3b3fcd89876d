"""Clean documents of languages with few or no trusted documents."""

import random

from factweave.llm import perplexity

LABELS = "doc_id long, quality int, toxic int"


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def documents():
    rng = random.Random(11)
    rows = [(i, prose(rng, "abcdefgh", 60), "en") for i in range(160)]
    rows += [(1000 + i, prose(rng, "ijklmnop", 60), "de") for i in range(24)]
    return rows + [(2000 + i, prose(rng, "αβγδεζηθ", 60), "el") for i in range(30)]


def test_languages_with_few_or_no_trusted_documents_keep_clean_ones(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, lang in documents() if lang != "el"], LABELS)
    got = perplexity.quality_report(docs, labels).collect()
    assert all(r.kept for r in got)


def test_thresholds(spark):
    held = spark.createDataFrame([("en", i / 1000) for i in range(1001)] + [("de", 2.0), ("de", 3.0), (None, 5.0)], "lang string, score double")
    got = {r.lang: r.threshold for r in perplexity.thresholds(held, "score", 0.995).collect()}
    assert round(got["en"], 6) == 0.995 and got["de"] >= 3.5 and got[None] > 5.0
