"""Every named query on the smallest data, against its SQL on DuckDB where there is one."""

import pytest

from ledgerlift.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    left, right, differences = compare(spark, duck, name, SF_DIR)
    if right == -1:
        assert left > 0
    else:
        assert (left, differences) == (right, [])
