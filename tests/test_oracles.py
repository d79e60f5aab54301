"""Every registered job against its DuckDB oracle on the sf0.001 tables
(the same comparison the correctness gate makes at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_job_matches_oracle(spark, con, name):
    got = digest(E.queries()[name](spark, SF).toPandas())
    want = digest(con.execute(E.oracle_sql()[name]).df())
    assert got[:3] == want[:3], (name, sorted(set(got[3]) ^ set(want[3]))[:4])
