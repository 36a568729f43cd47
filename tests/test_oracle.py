import pytest

from tests.compare import DATA, bag, connection
from tesserae.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    found, wanted = QUERIES[name](spark, DATA).toPandas(), connection().sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert bag(found) == bag(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
