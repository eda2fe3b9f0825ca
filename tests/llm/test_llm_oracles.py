"""The training-data queries that have SQL give the rows that DuckDB finds on the smallest tables; every other runs."""

import pytest

from helixmill.llm.queries import oracle_sql, queries
from tests.conftest import DATA
from tests.oracle import duck, spark_rows, sql_rows


@pytest.fixture(scope="module")
def db():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, DATA)
    if name in oracle_sql():
        assert spark_rows(df) == sql_rows(db, oracle_sql()[name])
    else:
        assert df.count() > 0
