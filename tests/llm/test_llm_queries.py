"""Queries with SQL give the SQL's rows; the others run on the smallest tables."""

import pytest
from codeloom.llm import queries, sql
from compare import DATA, assert_same


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA / "sf0.001"))
    if name in sql.SQL:
        assert_same(df, DATA / "sf0.001", sql.SQL[name])
    else:
        df.collect()
