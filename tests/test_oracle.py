import pytest

from postmill import problem_queries, queries
from tests.oracle import compare

ALL = {**queries.QUERIES, **problem_queries.QUERIES}
SQL = {**queries.SQL, **problem_queries.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, name, ALL[name], SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    df = ALL[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
