"""Every query of the catalog against its SQL, on the smallest test tables."""

from __future__ import annotations

import pytest
from compare import connect, differences, oracle_table
from conftest import DATA

from kpiloom.plans.catalog import QUERIES
from kpiloom.plans.oracle import ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, DATA).toArrow()
    assert result.num_rows > 0
    assert differences(result, oracle_table(duck, ORACLE_SQL[name])) == []
