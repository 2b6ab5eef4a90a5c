"""Every registered query against its DuckDB oracle (rows-only where none)."""

import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import duck, rows_of

SF = os.environ.get("TILLROLL_TEST_SF", "/root/testdata/sf0.001")
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(sp.columns) > 0
        return
    dd = con.execute(ORACLES[name]).df()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dd)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
