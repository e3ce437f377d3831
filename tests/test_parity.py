"""Every query with SQL must give the same rows as DuckDB does; the others must run."""

import pytest

from ledgerlight.plans.registry import ORACLE_SQL, QUERIES
from parity import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert compare(df, ORACLE_SQL[name], con) is None
    else:
        assert df.count() >= 0


def test_enough_rows(spark):
    assert QUERIES["i03_repeat_winner"](spark, SF).count() > 0
