"""Every registered query runs on the smallest tables and equals its DuckDB SQL."""

import pytest

import __spark_entry__ as entry
from tests.comparing import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    rows = frame.collect()
    if name in ORACLES:
        verdict = compare(frame.columns, rows, con, ORACLES[name])
        assert verdict.startswith("ok"), verdict
    else:
        assert rows
