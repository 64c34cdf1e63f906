"""Every query with SQL gives the SQL's rows on the small tables."""

import __spark_entry__ as entry
import pytest
from compare import DATA, assert_same

SQL = {k: v for k, v in entry.oracle_sql().items() if "llm" not in getattr(entry.queries()[k], "__module__", "")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert_same(entry.queries()[name](spark, str(DATA / "sf0.001")), DATA / "sf0.001", SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
