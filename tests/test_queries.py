import pytest
from oracle import connect, same

from quillon.plans import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    same(spark, sf, con, core.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert core.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 10 and rows[0].vec_id == 0
