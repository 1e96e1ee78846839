"""Every query that has SQL gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from meshspark.plans import file_queries, mesh_queries, table_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [*mesh_queries.queries(), *file_queries.queries(), *table_queries.queries()]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(r[k] for k in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = sql.execute(__spark_entry__.oracle_sql()[name])
    got = rows(df.columns, df.collect())
    told = rows([d[0] for d in want.description], want.fetchall())
    assert got[0] == told[0]
    assert got[1] == told[1]


def test_every_query_has_sql():
    assert set(mesh_queries.queries()) == set(mesh_queries.oracle_sql())
    assert set(file_queries.queries()) == set(file_queries.oracle_sql())
    assert set(table_queries.queries()) == set(table_queries.oracle_sql())
