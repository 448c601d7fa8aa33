"""Every catalogue query against its SQL twin in DuckDB, value by value."""

import math

import duckdb
import pytest

from pairwright.plans.oracles import ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, tables, name):
    from pairwright.plans.catalogue import QUERIES

    got = QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    mine = sorted((tuple(map(plain, row)) for row in got.select(columns).collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()), key=repr)
    assert mine == theirs
    assert mine, "a query without rows proves nothing"
