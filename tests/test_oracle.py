"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    frame = entry.queries()[name](spark, SF_DIR)
    if name in SQLS:
        assert differences(frame, connection, SQLS[name]) is None
    else:
        assert frame.count() > 0


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
