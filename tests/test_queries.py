"""Every registered query of the core against its SQL in another engine."""

import math
import os

import duckdb
import pytest

from nebulark.plans.analyses import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 9) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(ORACLE[name])
    want = table(rel.columns, rel.fetchall())
    assert got[0] == want[0] and got[1] == want[1]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_approximate_search_recall(spark):
    from nebulark.operators import neighbors
    from nebulark.plans.fixtures import view

    v = view(spark, SF, "vectors")
    asked = v.where("id % 5 = 0")
    exact = {(x.qid, x.id) for x in neighbors.vector_knn(asked, v, 10).collect()}
    found = {(x.qid, x.id) for x in neighbors.ivf_knn(asked, v, 10, neighbors.train_cells(v, 16), 8).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    everything = {(x.qid, x.id) for x in neighbors.ivf_knn(asked, v, 10, neighbors.train_cells(v, 16), 16).collect()}
    assert everything == exact
