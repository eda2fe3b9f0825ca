"""Every core query that has SQL gives the rows that DuckDB finds, on the smallest tables; every other runs."""

from importlib import import_module

import pytest

from tests.conftest import DATA
from tests.oracle import duck, spark_rows, sql_rows

MODULES = ("packed", "align", "modes", "screen", "evaluate", "genome")
CASES = [(m, q) for m in MODULES for q in import_module(f"helixmill.plans.{m}").queries()]


@pytest.fixture(scope="module")
def db():
    return duck(DATA)


@pytest.mark.parametrize("module,name", CASES)
def test_query(spark, db, module, name):
    mod = import_module(f"helixmill.plans.{module}")
    df = mod.queries()[name](spark, DATA)
    if name in mod.oracle_sql():
        assert spark_rows(df) == sql_rows(db, mod.oracle_sql()[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
