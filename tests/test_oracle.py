"""Every query with an SQL form agrees with it; the others return rows."""

import pytest
from check_oracle import SMALL, connect, differences

import __spark_entry__ as entry

# Long experiments: their parts are covered by the other tests.
LONG = {name for name in entry.queries() if name.endswith("_xval")} | {"final_eval", "refit_model"}


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert differences(spark, db, SMALL, name) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - LONG))
def test_query_returns_rows(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
