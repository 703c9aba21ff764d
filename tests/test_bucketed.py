"""Lineitem and orders bucketed by the order key: the same results, and no exchange below their join."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

from custval.plans.catalog import QUERIES
from custval.sources.tables import INVOICE_COLUMNS, invoice_lines, store_bucketed


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    made = store_bucketed(spark, SF_SMALL, "bucketed_test", str(tmp_path_factory.mktemp("bucketed")), buckets=4)
    yield made
    for name in ("lineitem", "orders"):
        spark.sql(f"DROP TABLE IF EXISTS bucketed_test_{name}")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("columns", [["Invoice", "Quantity", "Price"], list(INVOICE_COLUMNS)])
def test_join_without_exchange(spark, source, no_broadcast, columns):
    plan = _plan(invoice_lines(spark, source, columns))
    assert plan.count("SortMergeJoin") == 1 and "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert "Exchange" in _plan(invoice_lines(spark, SF_SMALL, columns))  # the plain files are dealt out for every read


def test_lines_are_the_same(spark, source):
    def rows(of):
        return sorted(map(str, invoice_lines(spark, of).collect()))

    assert rows(source) == rows(SF_SMALL)


@pytest.mark.parametrize("name", ["clv_model_inputs", "rfm_segments", "caps_upper", "invoice_totals", "null_profile", "omni_rfm", "clv_formula"])
def test_queries_are_the_same(spark, source, name):
    def rows(of):
        out = QUERIES[name](spark, of)
        return sorted(map(str, out.select(*sorted(out.columns)).collect()))

    assert rows(source) == rows(SF_SMALL)


def test_thresholds_and_inputs_read_the_join_without_exchange(spark, source, no_broadcast):
    """The aggregation per customer is the first exchange above the lines."""
    from custval.plans.retail import model_lines

    plan = _plan(model_lines(invoice_lines(spark, source)).groupBy("Customer ID").count())
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("SortMergeJoin")
