"""Operator 3: mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the text over its present share. A document's copies are the
inverse Poisson distribution of that mean at a hash of seed and doc_id: the table of the distribution is made once
per source, so a document costs one search in it. Copies are exploded and dealt over all partitions by a hash of
seed, doc_id and copy, then ordered by it: a global shuffle that is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, hex_to_long, lookup, materialize, read_table, text_of

#: A mean above this is drawn as a sum of equal parts, as exp(-mean) must not underflow.
LARGEST_PART = 500.0


def uniform(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return hex_to_long(F.substring(digest, 1, 13)) / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """Its distribution function at 0, 1, ... until the rest is below the resolution of uniform()."""
    first = F.exp(-mean)
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("table"))

    def step(a: Column, j: Column) -> Column:
        p = a["p"] * mean / j
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["table"], F.array(a["c"] + p)).alias("table"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["table"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, *, power: float = 0.7, scale: float = 1.0) -> DataFrame:
    """(source, rate): `weights` are target shares of the text in bytes (sources not named get none); without them the
    shares are the present ones to `power`, which lifts small sources. `scale`: size of the mix, in times the input."""
    sizes = docs.select("source", F.octet_length(text_of()).alias("b")).groupBy("source").agg(F.greatest(F.sum("b"), F.lit(1)).alias("bytes"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("bytes").cast("double"), F.lit(power)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        sizes = sizes.withColumn("w", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0))
    sizes = materialize(sizes, "mix-sources")
    total = sizes.agg(F.sum("w").alias("all_w"), F.sum("bytes").alias("all_b"))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_b") * scale / F.col("bytes")).otherwise(0.0)
    return sizes.join(F.broadcast(total)).select("source", rate.alias("rate"))  # total is one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, power: float = 0.7, scale: float = 1.0, seed: int = 42) -> DataFrame:
    """The copies, in a global random order within and over partitions: all columns of `docs` and mix_copy (from 1),
    mix_copies, mix_rate, mix_key.

    Null sources are a source; null texts have no bytes; rows repeated under one doc_id get equal counts. An empty
    table gives no rows. A column of `docs` with one of the added names is replaced. Texts of any length travel whole. A source's rate doesn't
    depend on the order or number of partitions.
    """
    rates = source_rates(docs, weights, power=power, scale=scale)
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_PART), F.lit(1)).cast("int")
    rates = materialize(rates.withColumn("parts", parts).select("source", "rate", "parts", poisson_table(F.col("rate") / F.col("parts")).alias("table")), "mix-rates")
    docs = docs.drop("mix_copy", "mix_copies", "mix_rate", "mix_key")
    table = free_name(docs, "poisson")
    rates = rates.select("source", F.struct("rate", "parts", "table").alias(table))
    rows = lookup(docs, rates, ["source"], F.col("doc_id"), how="inner")
    # the hash is taken once a part, not once an entry of the table
    drawn = F.transform(F.transform(F.sequence(F.lit(1), F.col(table)["parts"]), lambda k: uniform(F.lit(seed), F.col("doc_id"), k)), lambda u: F.size(F.filter(F.col(table)["table"], lambda c: c <= u)))
    copies = F.aggregate(drawn, F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("mix_copies", copies).where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    rows = rows.withColumn("mix_rate", F.col(table)["rate"]).drop(table)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("mix_copy").cast("string"), F.lit("order")).cast("binary"))
    return rows.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", F.col("mix_copy").alias("copy"), F.col("mix_copies").alias("copies"), F.round("mix_rate", 6).alias("rate"), "mix_key", "text")


SQL = """
WITH s AS (SELECT source, greatest(sum(strlen(coalesce(text, ''))), 1) AS bytes FROM documents GROUP BY source),
w AS (SELECT source, bytes, pow(bytes::DOUBLE, 0.7::DOUBLE) AS w FROM s),
r AS (SELECT source, w / (SELECT sum(w) FROM w) * (SELECT sum(bytes) FROM s)::DOUBLE / bytes AS rate FROM w),
p AS (SELECT source, rate, j, sum(exp(-rate) * pow(rate, j) / gamma(j + 1)) OVER (PARTITION BY source ORDER BY j) AS cdf FROM r, range(0, 100) t(j)),
t AS (SELECT source, any_value(rate) AS rate, list(cdf ORDER BY j) AS cdfs FROM p GROUP BY source),
d AS (SELECT doc_id, d.source, text, rate,
        len(list_filter(cdfs, lambda c: c <= ('0x' || substr(md5(concat('42:', coalesce(doc_id::VARCHAR, 'null'), ':1')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))::INT AS copies
      FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, copy::INT AS copy, copies, round(rate, 6) AS rate,
       md5(concat('42:', coalesce(doc_id::VARCHAR, 'null'), ':', copy, ':order')) AS mix_key, text
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM d WHERE copies > 0)
"""
