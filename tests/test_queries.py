"""Every catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from topicloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name not in registry.oracle_sql():
        assert len(got) > 0
        return
    want = oracle.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)
