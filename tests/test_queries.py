import pytest
from conftest import DATA, same

from flowledger.plans import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck, ORACLE[name])


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry_registers_the_library(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
