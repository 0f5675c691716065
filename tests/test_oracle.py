"""Every registered query against its SQL text on the smallest tables."""

import os

import pytest

import oracle
from stayline.bindings.registry import all_bound

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BOUND = all_bound()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(BOUND))
def test_query(spark, con, name):
    difference, _, rows = oracle.compare(spark, con, name, BOUND[name], SF_DIR)
    assert difference is None
    assert rows > 0
