"""Every registered query against its DuckDB oracle (the driver's gate).

Runs at sf0.001 by default; set COURIERFLOW_CHECK_SF=/root/testdata/sf0.01
for the driver's scale."""

import os

import pytest

from courierflow.plans.catalog import load_all
from courierflow.plans.verify import compare, duck_connect

SF = os.environ.get("COURIERFLOW_CHECK_SF", "/root/testdata/sf0.001")
ENTRIES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, SF, con)
    assert res["status"] in ("match", "rows-only"), res


def test_entry_contract(spark):
    import importlib
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
