"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    verdict = compare.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert verdict.startswith(("ok", "rows-only")), verdict
    assert "types" not in verdict, verdict


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
