"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from check_oracles import compare, connect
from dossierlake.plans.registry import registered

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ITEMS = registered()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(ITEMS))
def test_query(spark, con, name):
    compare(spark, con, ITEMS[name], SF_DIR)
