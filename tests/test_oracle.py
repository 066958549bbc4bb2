"""Every check query with SQL gives the same rows and types in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


#: Four fits of 200 trees, level by level; run it with RUN_SLOW=1 or tests/oracle.py.
SLOW = {"q_benchmark"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, small_dir, name):
    if name in SLOW and not os.environ.get("RUN_SLOW"):
        pytest.skip("slow")
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], small_dir) == ""


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["dataset", "train", "test"] and out.count() == 2
