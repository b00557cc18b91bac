"""Every registered query against its SQL, at the smallest scale."""

import pytest
from compare import compare, duck

from geoloom.catalog import load

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(load()))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER) == []
