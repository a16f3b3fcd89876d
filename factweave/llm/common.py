"""Helpers shared by the training-data operators: text rules, hashes, shared storage, skew-safe lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.graph import cut as materialize  # noqa: F401
from factweave.session import ship_package

#: Words are maximal runs of anything but space and U+0009..U+000D.
SPLIT_PATTERN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow for a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, so that other letters keep their bytes."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT_PATTERN), "")


def hex_to_long(digits: Column) -> Column:
    """At most 15 hex digits as a long."""
    return F.conv(digits, 16, 10).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salt_of(column: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def salts_in(seen: str, salts: int) -> Column:
    """The numbers of the bits that are set in the long column `seen`."""
    return F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.call_function("bit_get", F.col(seen), s) == 1)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, *, how: str = "left", bound: int = 20_000, most_bytes: int = 32_000_000, salts: int = 32) -> DataFrame:
    """Joins `small` (one row a key) to `big` without letting a hot key of `big` fill one task.

    `small` is measured first: up to `bound` rows and `most_bytes` it is broadcast; beyond, each of its rows is repeated
    `salts` times and the rows of `big` choose a copy by `spread`; the copies are merged and never broadcast, as Spark takes
    their size for that of `small` and would gather them in the driver. Null keys match null keys. Both ways give the
    columns of `big`, then those of `small` but the keys.
    """
    used, names = big, {}
    for k in [*keys, "salt", "copy"]:
        names[k] = free_name(used, f"lookup_{k}")
        used = used.withColumn(names[k], F.lit(0))
    right = small.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in small.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(names[k]))
    rows, size = small.limit(bound + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*small.columns)))), F.lit(0))).first()
    if rows <= bound and size <= most_bytes:
        return big.join(F.broadcast(right), same, how).drop(*[names[k] for k in keys])
    right = right.withColumn(names["copy"], F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    left = big.withColumn(names["salt"], salt_of(spread, salts))
    return left.join(right, same & (F.col(names["salt"]) == F.col(names["copy"])), how).drop(names["salt"], names["copy"], *[names[k] for k in keys])
