"""Every core query with SQL against that SQL; every other one for running with stable columns and not empty where it shouldn't be."""

import pytest

from tests.compare import check
from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()
# Needs more history than the smallest tables have.
MAY_BE_EMPTY = {"walk_forward_models", "pipeline_advantage", "report_markdown"}


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir).toPandas()
    assert len(out.columns) > 0 and (len(out) > 0 or name in MAY_BE_EMPTY)
