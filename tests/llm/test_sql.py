"""Every query of the subpackage that has SQL against DuckDB on the driver's tables."""

from __future__ import annotations

import os

import parity
import pytest

from tessella.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, db, name):
    assert parity.difference(spark, db, queries()[name], oracle_sql()[name], SF) == ""
