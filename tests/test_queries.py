"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import check_oracle
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_oracle.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, FOLDER).toPandas()
    if name in oracle_sql():
        want = con.execute(oracle_sql()[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert check_oracle._canonical(got) == check_oracle._canonical(want)
    else:
        assert len(got) > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 2
