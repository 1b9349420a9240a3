"""Every registered query against its SQL, on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as contract
from registry.check import compare, connect

FOLDER = os.environ.get("TERMLOOM_TEST_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


# The optional operators' queries are tested with their operators.
NAMES = sorted(n for n in contract.queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    status, _, rows = compare(spark, duck, FOLDER, name)
    assert status in ("ok", "rows only") and rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
