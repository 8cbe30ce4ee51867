import duckdb
import pytest

import __spark_entry__ as entry
from loomspan import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in Q.ORACLE_SQL:
        assert got
        return
    sql = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in sql.select(*columns).fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
