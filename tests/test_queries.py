"""Every registered query of the engine: the same rows from DuckDB, or stable rows without SQL."""

import pytest

from quillmer.queries import ORACLE_SQL, QUERIES
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) and rows_of(got, columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_iterative_queries_are_repeatable(spark, sf, name):
    a, b = QUERIES[name](spark, sf).toPandas(), QUERIES[name](spark, sf).toPandas()
    assert len(a) and rows_of(a, list(a.columns)) == rows_of(b, list(b.columns))


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
