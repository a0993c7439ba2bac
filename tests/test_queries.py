"""Every query with checking SQL gives the same rows in both engines."""

import os

import duckdb
import pytest
from compare import TABLES, connect, differences, kinds
from test_contenders import FITS

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_entry_runs(spark):
    out = contract.entry(spark)
    assert out.columns == ["unit_id", "n_rows", "risk", "peak", "high_risk_share", "flagged"]
    assert out.count() == 10


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


# Fits; tests/test_contenders.py runs these.
LONG = {*FITS, "param_search"}


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - LONG))
def test_same_rows_as_sql(spark, small, con, name):
    ours = contract.queries()[name](spark, small).toPandas()
    theirs = con.execute(contract.oracle_sql()[name]).df()
    assert differences(ours, theirs) == []
    if len(ours) and not ours.isna().any().any():
        assert kinds(ours) == kinds(theirs)


SKEWED = (
    "load_readings",
    "temporal_features",
    "temporal_detector",
    "stuck_blocks",
    "monotone_window",
    "equal_run",
    "window_tensor",
    "time_to_failure",
    "unit_rollup",
    "compare_rollups",
    "grouped_folds",
    "event_time_to_rows",
    "score_ladder",
    "sustained_risk_stream",
)


@pytest.fixture(scope="module")
def one_large_unit(middle, tmp_path_factory):
    """The middle tables with half of all rows in one unit, many blocks long."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{middle}/{t}.parquet", f"{folder}/{t}.parquet")
    duckdb.connect().execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE l_suppkey END AS l_suppkey)
        FROM (SELECT *, row_number() OVER (PARTITION BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
          l_quantity ORDER BY l_suppkey) AS copy FROM '{middle}/lineitem.parquet') WHERE copy = 1)
        TO '{folder}/lineitem.parquet' (FORMAT parquet)"""
    )
    return folder


@pytest.mark.parametrize("name", SKEWED)
def test_same_rows_with_one_large_unit(spark, one_large_unit, name):
    ours = contract.queries()[name](spark, one_large_unit).toPandas()
    theirs = connect(one_large_unit).execute(contract.oracle_sql()[name]).df()
    assert differences(ours, theirs) == []
