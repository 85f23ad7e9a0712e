"""Every query with a SQL twin gives the same rows, names and types as DuckDB does."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, database  # noqa: E402
from veilspark.checks import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SLOW = {"sample_all_counts"}


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in SLOW])
def test_same_as_sql(spark, con, name):
    text, _, ok = compare(spark, con, SF, name)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
