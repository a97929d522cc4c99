"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from runfield.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def rows_of(frame):
    def plain(v):
        if v is None or v is getattr(__import__("pandas"), "NA", None) or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    found, expected = catalogue.queries()[name](spark, SF).toPandas(), duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() == 617 and found.agg({"S": "sum"}).first()[0] == 1897


def test_every_oracle_names_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
