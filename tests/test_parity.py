"""Every query with an SQL equivalent against DuckDB on the driver's tables; the others run."""

from __future__ import annotations

import os

import parity
import pytest

from tessella import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    fn, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql:
        assert parity.difference(spark, db, fn, sql, SF) == ""
    else:
        assert fn(spark, SF).count() > 0
