import pytest

from lexspark.plans import registry
from tests.conftest import SF


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(registry.QUERIES[name](spark, SF), registry.ORACLE[name])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE])
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
