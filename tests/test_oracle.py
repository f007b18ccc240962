"""Every registered query against its SQL on the smallest data set."""

import pytest
from compare import compare, data_dir

from rootscope.queries.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, key):
    assert compare(spark, QUERIES[key], ORACLES[key], data_dir("sf0.001")) == []


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, key):
    assert QUERIES[key](spark, data_dir("sf0.001")).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
