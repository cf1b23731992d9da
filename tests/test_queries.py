"""Every registered query next to its reference SQL on the smallest tables."""

import os

import pytest

from readlake.plans import ORACLE, QUERIES
from tests.compare import compare, duck

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    compare(spark, con, FOLDER, name, QUERIES[name], ORACLE.get(name))


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
