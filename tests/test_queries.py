import pytest

from rankfold.plans import registry

NO_SQL = sorted(set(registry.QUERIES) - set(registry.SQL))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", NO_SQL)
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
