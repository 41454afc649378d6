"""Every registered query against its DuckDB twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import compare, connect

if not os.path.isdir(SF):
    pytest.skip("test tables are not here", allow_module_level=True)

CON = connect(SF)
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    if name in ORACLES:
        assert compare(df, CON, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 11
