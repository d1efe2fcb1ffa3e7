"""Every plan against its SQL on the smallest tables; plans without SQL must give rows."""

import compare
import pytest

from attestary.plans import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_plan(spark, con, name):
    got = compare.actual(QUERIES[name](spark, FOLDER))
    if name in ORACLES:
        assert compare.difference(got, compare.expected(con, ORACLES[name])) is None
    else:
        assert got[1]
