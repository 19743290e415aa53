"""Every query of the ledger against its SQL in DuckDB, on the smallest test tables."""

import os
from glob import glob

import duckdb
import pytest

from tallychain.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    if name not in registry.oracle_sql():
        assert rows
        return
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
