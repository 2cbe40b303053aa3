"""Every core query with SQL gives the rows DuckDB gives over the smallest tables."""

import os

import pytest
from compare import both, connection

from tallyframe.plans import registries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {n: (q, r.sql.get(n)) for r in registries() for n, q in r.queries.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", [n for n, (_, s) in QUERIES.items() if s])
def test_same_rows(spark, con, name):
    ours, theirs = both(spark, con, *QUERIES[name], DATA)
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n, (_, s) in QUERIES.items() if not s])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, DATA).count() >= 0
