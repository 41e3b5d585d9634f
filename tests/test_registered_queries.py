"""Every registered query against its SQL check on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    frame = entry.queries()[name](spark, SF_DIR)
    if name in CHECKS:
        assert difference(frame, con, CHECKS[name]) is None
    else:
        assert frame.count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
