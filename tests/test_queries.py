"""Every registered query against its SQL in DuckDB; the others must give rows."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

FOLDER = os.environ.get("LIMNOS_TEST_FOLDER", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLES.get(name)) == ""


@pytest.mark.parametrize("name", ["join_scalar_total", "data_completeness", "common_to_all_groups", "drop_sparse_columns", "multi_unit_targets", "boxplot_stats",
                                  "find_time_traces", "find_time_traces_year"])
def test_the_raw_table_is_scanned_once(spark, name):
    """What is left to run reads the raw rows at most once: the parts that need them again read a written result."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert sum("lineitem.parquet" in line for line in plan.splitlines() if "FileScan" in line) <= 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["site_id", "target", "year"] and df.count() > 0
