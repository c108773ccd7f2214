"""The parts of the operators that SQL can state, against DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from seqspark.llm.queries import ORACLE_SQL, QUERIES

from .conftest import collected

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert len(at) == len(want.description)
    assert collected(got.select(*columns)) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)
