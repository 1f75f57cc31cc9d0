"""Every query with a SQL twin against that twin; the others for shape."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402

QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_sql(spark, sf, con, name):
    assert oracle.differences(QUERIES[name](spark, sf), con, TWINS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS) - {"run_analysis", "compare_methods", "training_loss"}))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
