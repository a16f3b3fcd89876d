"""Each analysis query against its SQL, and the interval and graph operators on edge cases."""

import duckdb
import pytest

from factweave.functions import interval as I
from factweave.operators import graph
from factweave.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for table in ("events", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    got = catalog.queries()[name](spark, SF)
    wanted = oracle.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, wanted.select(*columns).fetchall()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


VALUES = [(1, 3), (-4, 2), (None, None), (3, 1), (0, 0), (I.NEG, 5), (2, I.POS), (I.NEG, I.POS), (I.POS, I.POS), (I.NEG, I.NEG)]


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(a, b, c, d) for a, b in VALUES for c, d in VALUES]
    return spark.createDataFrame(rows, "a long, b long, c long, d long"), I.interval("a", "b"), I.interval("c", "d")


def test_lattice_laws(grid):
    rows, x, y = grid
    laws = [
        I.le(x, I.join(x, y)), I.le(y, I.join(x, y)), I.le(I.meet(x, y), x), I.le(I.meet(x, y), y), I.le(I.join(x, y), I.widen(x, I.join(x, y), [0, 16])),
        I.le(I.prune("lt", x, y), x), I.le(I.prune("ne", x, y), x), I.le(x, I.minus(I.plus(x, y), y)) | I.is_bottom(y),
    ]
    for law in laws:
        assert rows.where(~law | law.isNull()).count() == 0


def test_infinities_the_wrong_way_round_are_bottom(grid):
    rows, x, _ = grid
    assert {(r.a, r.b) for r in rows.where(I.is_bottom(x)).collect()} == {(None, None), (3, 1), (I.POS, I.POS), (I.NEG, I.NEG)}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_graphs(spark):
    g = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (7, 8)])
    assert {tuple(r) for r in graph.components(g).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}
    assert {tuple(r) for r in graph.distances(g, edges(spark, [(1, 1)]).selectExpr("src node")).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    start = edges(spark, [(1, 1)]).selectExpr("src node")
    assert {tuple(r) for r in graph.shortest_paths(edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (9, 4)]), start).collect()} == {(1, 0, 1), (2, 1, 2), (2, 0, 1), (3, 1, 3), (3, 0, 1), (4, 2, 4), (4, 1, 2), (4, 0, 1)}
    none = edges(spark, [])
    assert graph.closure(none).count() == graph.components(none).count() == 0


def test_ranks(spark):
    from pyspark.sql import functions as F

    from factweave.operators.ranking import ranked, take_top

    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("w"))
    wanted = {(i, n + 1) for n, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 3), i)))}
    assert {(r.id, r["rank"]) for r in ranked(rows, [F.desc("w"), F.asc("id")]).collect()} == wanted
    assert take_top(rows, [F.desc("w"), F.asc("id")], 10).count() == 100
    assert ranked(rows.where("id < 0"), [F.asc("id")]).count() == 0
