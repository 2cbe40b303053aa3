"""Every training-data query with SQL gives the rows DuckDB gives over the smallest tables; the others run."""

import os

import pytest
from compare import both, connection

from tallyframe.llm.queries import R

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(R.sql))
def test_same_rows(spark, name):
    ours, theirs = both(spark, connection(DATA), R.queries[name], R.sql[name], DATA)
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n in R.queries if n not in R.sql])
def test_runs(spark, name):
    assert R.queries[name](spark, DATA).count() >= 0
