"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from lexstrata.registry import QUERIES

from .oracle import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, duck, key):
    assert compare(spark, duck, key, SF_DIR) is None
