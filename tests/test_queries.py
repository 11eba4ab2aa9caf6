"""Each query of the experiment operators against its DuckDB statement, on the smallest tables."""

import lodestone.plans.result_queries  # noqa: F401  registers more queries
import pytest
from comparison import duck_rows, spark_rows
from lodestone.plans.oracles import ORACLES
from lodestone.plans.queries import QUERIES

LEARNT = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal(spark, sf_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    other, wanted = duck_rows(ORACLES[name], sf_dir)
    assert names == other
    assert rows == wanted


@pytest.mark.parametrize("name", LEARNT)
def test_learners_give_finite_rows(spark, sf_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert rows and not any("nan" in r or "inf" in r for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
