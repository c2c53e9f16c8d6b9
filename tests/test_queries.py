"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from conftest import TABLES


@pytest.fixture(scope="module")
def con():
    return connect(TABLES)


def test_every_query_has_a_twin():
    assert set(entry.QUERIES) == set(entry.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", list(entry.QUERIES))
def test_query(spark, con, key):
    assert compare(spark, con, TABLES, key) is None


def test_an_audit_does_not_shuffle_pages(spark):
    """With few sites no exchange moves pages."""
    plan = entry.queries()["page_scores"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    pages_side = plan.split("BroadcastExchange")[0]
    assert pages_side.count("Exchange") == 0
    assert plan.count("ArrowEvalPython") == 1
