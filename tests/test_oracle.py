"""Every catalogued query against its DuckDB SQL on the smallest test tables (row count, column names, values)."""

import os
import sys

import pytest

import __spark_entry__ as entry
from replyscope.plans.oracle import SQL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import duck, rows_of  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SMOKE)
    srows, scols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(entry.oracle_sql()[name])
    drows, dcols = rows_of(rel.columns, rel.fetchall())
    assert scols == dcols
    assert len(srows) == len(drows)
    assert srows == drows


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["cohort_type", "cohort", "accuracy"]
    assert df.count() > 0
