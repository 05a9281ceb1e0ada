import pytest
from oracle import connect, rows

from phonolake import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
