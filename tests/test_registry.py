import pytest

import __spark_entry__
from epochlens.plans import registry
from tests.oracle import SF, rows_of, sql_rows


def test_entry_is_the_flagship(spark):
    assert "query_id" in __spark_entry__.entry(spark).columns
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    got = rows_of(registry.queries()[name](spark, SF).toPandas())
    assert got == sql_rows(registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
