import duckdb
import pytest

from flowframe.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    relation = oracle.sql(ORACLES[name])
    names = relation.columns
    theirs = sorted(repr(tuple(dict(zip(names, r))[c] for c in columns)) for r in relation.fetchall())
    assert sorted(names) == columns and ours == theirs
