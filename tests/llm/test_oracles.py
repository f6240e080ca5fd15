"""Queries with SQL: the same rows from DuckDB."""

import pytest

from quillmer.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows_of(got, columns) == rows_of(want, columns)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
