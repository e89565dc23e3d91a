"""Every registered query against its DuckDB oracle on the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from starlayer.plans import catalog  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

KEYS = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    status, n1, n2, _t, msg = compare(spark, con, SF_SMALL, key, entry.queries()[key], entry.oracle_sql().get(key))
    assert status in ("OK", "ROWS"), f"{key}: {status} {msg}"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "paid_rate" in df.columns


def test_every_query_has_a_docstring_or_oracle():
    sql = catalog.oracle_sql()
    rows_only = [k for k in catalog.queries() if k not in sql]
    # Rows-only keys are the engine-specific ones: file sizes, plans, timings.
    assert set(rows_only) <= {"perf_table_size", "perf_explain", "report_performance", "quality_report_full",
                              "compact_files", "profile_columns_approx"}
