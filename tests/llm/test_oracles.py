"""The queries that have SQL give its rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parity import compare, connect  # noqa: E402

from ledgerlight.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], connect(SF)) is None
