"""Operator 10: line-first cleaning.

Each line is judged alone (shouting, symbols, navigation, boilerplate, missing punctuation) and lines that fail are
removed; a document goes when too much of its text went with them. All of it is one projection over arrays in a
row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, text_of, words_of

WINDOW = 8
#: Characters that count as symbols, and phrases of boilerplate lines (lower case).
SYMBOLS = "#*$%&|<>"
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum")


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """__keep (a struct of `keep`), __text, __lines and the counts of the base rules."""
    rows = docs.select(F.struct(*keep).alias("__keep"), text_of().alias("__text")).withColumn("__words", words_of(F.col("__text")))
    rows = rows.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    windows = F.when(
        F.size("__words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("__hashes"), i + k) for k in range(WINDOW)])),
    )
    rows = rows.withColumn("__windows", windows)
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    rows = rows.withColumn("__sorted", F.when(again, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        "__sorted",
        lambda x, k: F.coalesce(x["h"] == F.get(F.col("__sorted"), k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(F.col("__sorted"), k + 1)["h"], F.lit(False)),
    )
    # equal hashes only propose: the windows' words are compared
    named = F.transform(twice, lambda x: F.struct(F.array_join(F.slice("__words", x["i"] + 1, WINDOW), " ").alias("s"), x["i"].alias("i")))
    rows = rows.withColumn("__named", F.array_sort(named))
    equal = F.filter(
        "__named",
        lambda x, k: F.coalesce(x["s"] == F.get(F.col("__named"), k - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get(F.col("__named"), k + 1)["s"], F.lit(False)),
    )
    rows = rows.withColumn("__starts", F.array_sort(F.transform(equal, lambda x: x["i"])))
    steps = F.transform("__starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__starts"), k + 1) - p, F.lit(WINDOW))))
    return rows.select(
        "__keep", "__text", "__lines",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def line_is_good(line: Column) -> Column:
    """False for lines that are navigation, symbols, shouting or boilerplate, or long ones without any punctuation."""
    chars = F.length(line)
    lost = lambda drop: chars - F.length(F.translate(line, drop, ""))
    n_spaces = lost(" \t")
    navigation = (lost("|") >= 3) & (lost("|") * 4 >= n_spaces)
    symbols = lost("#*$%&<>") * 12 >= chars
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shouting = (lost(letters) * 2 >= chars) & (chars >= 20)
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    boilerplate = boilerplate & (chars <= 200)
    unpunctuated = (n_spaces >= 30) & (lost(".,;:!?") == 0)
    return ~(navigation | symbols | shouting | boilerplate | unpunctuated)


def clean_lines(docs: DataFrame, *, keep: list[str] | None = None, most_lost: float = 0.5, fewest_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """One row per row of `docs`: `keep` columns (doc_id), the base counts, base_failed, clean_text, share_lost, kept.

    Base: fewer than `fewest_words` words, or over `most_repeated` percent of words in repeated 8-word windows.
    A document whose base holds is kept if its failing lines hold at most `most_lost` of the characters of its lines.
    Null and empty texts have no words and fail. Repeated rows are judged alike. Windows are
    found by 64-bit hashes and compared word for word. Very long texts are judged whole. An empty table gives no rows.
    `keep` may hold any columns but those added here.
    """
    keep = keep or ["doc_id"]
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "share_lost", "clean_text"]
    if clash := {k.lower() for k in keep} & set(added):
        raise ValueError(f"keep: {sorted(clash)} are added here")
    rows = base_counts(docs, keep).withColumn("__good", F.filter("__lines", line_is_good))
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    rows = rows.withColumn("__all", total(F.col("__lines"))).withColumn("share_lost", F.when(F.col("__all") > 0, 1 - total(F.col("__good")) / F.col("__all")).otherwise(0.0))
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("share_lost") <= most_lost))
    return rows.withColumn("clean_text", F.array_join("__good", "\n")).select("__keep.*", *added)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return clean_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM a WHERE len(w) >= 8),
named AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM named) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dup, range(0, 8) r(k) GROUP BY doc_id),
g AS (SELECT doc_id, t, w, l, list_filter(l, lambda x: NOT (
        (len(x) - len(replace(x, '|', '')) >= 3 AND (len(x) - len(replace(x, '|', ''))) * 4 >= len(x) - len(translate(x, chr(32) || chr(9), '')))
        OR (len(x) - len(translate(x, '#*$%&<>', ''))) * 12 >= len(x)
        OR ((len(x) - len(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) * 2 >= len(x) AND len(x) >= 20)
        OR (regexp_matches(lower(x), 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript|lorem ipsum') AND len(x) <= 200)
        OR (len(x) - len(translate(x, chr(32) || chr(9), '')) >= 30 AND len(x) = len(translate(x, '.,;:!?', ''))))) AS good FROM a),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
             (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             CASE WHEN len(l) > 0 THEN 1 - list_sum(list_transform(good, lambda x: len(x))) / list_sum(list_transform(l, lambda x: len(x))) ELSE 0 END AS lost,
             len(good) AS n_good, len(l) AS n_lines FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AND (n_good > 0 AND lost <= 0.5) AS kept
FROM c LEFT JOIN rep USING (doc_id)
"""
