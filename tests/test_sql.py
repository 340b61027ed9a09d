"""Each query with SQL gives the rows that DuckDB gives."""

import pytest

from compare import connect, rows
from tessera.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, small, name):
    ours, theirs = QUERIES[name](spark, small).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_run(spark, small, name):
    assert QUERIES[name](spark, small).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 25
    assert set(E.oracle_sql()) <= set(E.queries())
