"""Every registered query against its SQL twin."""

import oracle
import pytest

import __spark_entry__ as entry
from fieldspark.plans import all_queries, registry

# The queries of the library itself; the llm subpackage has tests of its own.
all_queries.load()
QUERIES = registry.QUERIES
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def con(small_dir):
    return oracle.connect(small_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, small_dir, name):
    rows, problem = oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], small_dir)
    assert not problem
    assert rows > 0 or name in {"j12_missing_samples"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == entry.queries()[entry.FLAGSHIP](spark, "/root/testdata/sf0.001").columns
    assert df.count() > 0


def test_no_query_lacks_sql():
    assert set(QUERIES) == set(ORACLES)
