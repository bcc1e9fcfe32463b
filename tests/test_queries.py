"""Every registered query with SQL gives the rows that DuckDB gives; the others run."""

import pytest
from oracle import connect, same

from assayer import plans

SQL, QUERIES = plans.sql(), plans.queries()
SLOW = {"bench_summary", "glm_cv_path"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(name, spark, sf, con):
    same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["metric", "model", "naive"]
    assert set(plans.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
