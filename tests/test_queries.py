"""Every registered query of the engine against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from flatsql import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


def plain(value):
    if isinstance(value, float) and math.isfinite(value) or isinstance(value, int) and not isinstance(value, bool):
        return f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_duckdb(spark, oracle, name):
    df = queries.QUERIES[name](spark, DIR)
    got = [tuple(map(plain, r)) for r in df.collect()]
    cursor = oracle.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = [tuple(map(plain, r)) for r in cursor.fetchall()]
    assert df.columns == columns
    assert sorted(got) == sorted(want)
    if "ORDER BY" in queries.ORACLE_SQL[name] and "LIMIT" in queries.ORACLE_SQL[name]:
        assert got == want
