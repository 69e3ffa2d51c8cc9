"""Every query with an oracle gives the oracle's rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import compare, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_names():
    queries = entry.queries()
    assert set(ORACLES) <= set(queries)
    assert len(queries) > 130


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, ORACLES[name]) == []
