"""Pipelines against goldens and the SQL oracle; plan shape checks."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from custval.operators.quantiles import Cut, qcut_many
from custval.plans.retail import rfm_retail
from custval.sources.tables import invoice_lines
from golden import invoice_frame, rfm_golden
from oracle_check import compare, duck


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "segment" in df.columns


def test_rfm_matches_its_definition(spark):
    lines = invoice_frame(SF_SMALL)
    today = lines[~lines.Invoice.str.contains("C")].InvoiceDate.max().normalize() + pd.Timedelta(days=2)
    want = rfm_golden(lines, today.to_pydatetime())
    rows = rfm_retail(invoice_lines(spark, SF_SMALL)).collect()
    assert len(rows) == len(want)
    for r in rows:
        scores = (r.recency_score, r.frequency_score, r.monetary_score, r.segment)
        assert (r.recency, r.frequency, r.monetary, *scores) == want[r.customer_id]
        assert r.RF_SCORE == f"{r.recency_score}{r.frequency_score}"


def test_rfm_analysis_date_parameter(spark):
    a = rfm_retail(invoice_lines(spark, SF_SMALL), analysis_date=dt.datetime(2001, 8, 3)).toPandas()
    b = rfm_retail(invoice_lines(spark, SF_SMALL), analysis_date=dt.datetime(2002, 8, 3)).toPandas()
    a, b = a.sort_values("customer_id"), b.sort_values("customer_id")
    assert ((b.recency.values - a.recency.values) == 365).all()
    assert (a.segment.values == b.segment.values).all()


FAST = [
    "rfm_segments", "rfm_segment_report", "clv_formula", "clv_segment_report", "omni_rfm",
    "campaign_brand", "caps_both_rounded", "clv_model_inputs", "bgnbd_score", "sub_segments",
    "kpi_retention", "event_recency_days", "null_profile", "numeric_summary",
]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duck(SF_SMALL)
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert compare(name, got, want) is None


def test_every_query_has_oracle_or_is_a_fit():
    from custval.plans.catalog import QUERIES

    rows_only = set(QUERIES) - set(E.oracle_sql())
    assert rows_only == {"bgnbd_fit", "gg_fit", "clv_predict_retail", "clv_predict_omni"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_plan_is_a_narrow_projection(spark):
    base = spark.range(1000).selectExpr("id AS k", "CAST(id % 37 AS DOUBLE) AS x")
    out = qcut_many(base, [Cut("x", 5, None, "b")], "k")
    plan = _plan(out)
    assert "Exchange" not in plan and "Window" not in plan


def test_no_python_udfs_in_pipelines(spark):
    out = rfm_retail(invoice_lines(spark, SF_SMALL))
    plan = _plan(out)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "SinglePartition" not in plan


SCALE_PATH = ["rfm_scores", "omni_rfm", "clv_segments", "caps_upper", "numeric_summary", "sub_segments", "frequency_ranks"]


@pytest.mark.parametrize("name", SCALE_PATH)
def test_query_matches_oracle_on_the_multi_partition_path(spark, name, monkeypatch):
    """Force the range/histogram order-statistics paths (tiny partitions)."""
    import custval.operators.order_stats as order_stats

    monkeypatch.setattr(order_stats, "ROWS_PER_PARTITION", 40)
    con = duck(SF_SMALL)
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert compare(name, got, want) is None


def test_scoring_evaluates_distinct_pairs(spark):
    from custval.plans.catalog import CDNOW_BGNBD, CDNOW_GAMMA_GAMMA
    from custval.plans.predict import score_customers

    inputs = spark.range(1000).selectExpr("id AS customer_id", "id % 5 + 2 AS frequency", "1.0D AS recency", "id % 3 + 9.0D AS T", "5.0D AS monetary")
    plan = _plan(score_customers(inputs, CDNOW_BGNBD, CDNOW_GAMMA_GAMMA))
    assert plan.count("aggregate(arrays_zip") <= 1 and "HashAggregate" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_pruned_views_join_what_they_need(spark):
    def tables(columns):
        plan = _plan(invoice_lines(spark, SF_SMALL, columns))
        return {t for t in ("lineitem", "orders", "part", "customer", "nation") if f"/{t}.parquet" in plan}

    assert tables(["Invoice", "Quantity", "Price"]) == {"lineitem", "orders"}
    assert tables(["Description"]) == {"lineitem", "orders", "part"}
    assert tables(["Country"]) == {"lineitem", "orders", "customer", "nation"}


def test_line_level_sketch_meets_in_groups(spark):
    """Scan tasks' sketches are shuffled by group; only the groups' sketches meet in one task."""
    import custval.operators.order_stats as order_stats

    seen = []
    df = spark.range(0, 200_000, 1, 8).selectExpr("CAST(id % 1000 AS DOUBLE) AS x")
    frame = type(df)
    first = frame.first
    frame.first = lambda self: (seen.append(_plan(self)), first(self))[1]
    try:
        values = order_stats.sketch_quantiles(df, "x", [0.0, 0.5, 1.0])
    finally:
        frame.first = first
    assert values[0] == 0.0 and values[2] == 999.0 and abs(values[1] - 500.0) <= 3
    assert "hashpartitioning(g" in seen[0]
    single = seen[0].index("SinglePartition")
    assert "kll_merge_agg_double" in seen[0][:single] and "kll_sketch_agg_double" not in seen[0][:single].split("kll_merge_agg_double")[0]


def test_reports_keep_small_values(spark):
    from custval.operators.reports import group_report

    rows = [("a", 1e-9 * (i + 1)) for i in range(10)] + [("b", 3e12 + i) for i in range(10)]
    got = {r.g: r for r in group_report(spark.createDataFrame(rows, "g string, v double"), "g", ["v"]).collect()}
    assert got["a"].v_sum == pytest.approx(5.5e-8, rel=1e-12) and got["a"].v_mean == pytest.approx(5.5e-9, rel=1e-12)
    assert got["b"].v_mean == pytest.approx(3e12 + 4.5, rel=1e-15)


def test_prediction_parameters(spark):
    """A pinned date equals the default rule's date; a later one ages every customer alike."""
    from custval.plans.predict import clv_predict_omni, clv_predict_retail, merge_by_key
    from custval.sources.tables import customer_summary, default_analysis_date

    lines = invoice_lines(spark, SF_SMALL)
    rule = default_analysis_date(lines.where("Invoice NOT LIKE 'C%'"), "InvoiceDate")
    default = clv_predict_retail(lines).table
    pinned = clv_predict_retail(lines, analysis_date=rule, horizons={"two_weeks": 2.0}, bg_penalizer=0.001, gg_penalizer=0.01).table
    later = clv_predict_retail(lines, analysis_date=rule + dt.timedelta(weeks=3), discount_rate=0.05).table
    a, b, c = ({r.customer_id: r for r in t.collect()} for t in (default, pinned, later))
    assert a.keys() == b.keys() == c.keys() and "two_weeks" in pinned.columns and "expected_purc_1_week" not in pinned.columns
    assert all(abs(a[k]["T"] - b[k]["T"]) < 1e-9 and abs(c[k]["T"] - a[k]["T"] - 3.0) < 1e-9 for k in a)
    assert all(a[k].clv == pytest.approx(b[k].clv, rel=1e-6) for k in a)
    merged = merge_by_key(lines.select("Customer ID").distinct().withColumnRenamed("Customer ID", "customer_id"), default)
    assert merged.where("clv is not null").count() == len(a)
    summary = customer_summary(spark, SF_SMALL)
    script = clv_predict_omni(summary, horizons={"a": 1.0}, repeat_only=False, split_top=True, analysis_date=rule)
    assert {"a", "clv"} <= set(script.table.columns)


def test_calibration_of_a_fitted_model(spark):
    from custval.operators.bgnbd import fit_bgnbd
    from custval.plans.predict import calibration
    from custval.plans.retail import model_inputs_retail
    from custval.session import materialize

    inputs = materialize(model_inputs_retail(invoice_lines(spark, SF_SMALL)))
    fit = fit_bgnbd(inputs)
    rows = calibration(fit.params, inputs, 4).orderBy("frequency").collect()
    assert [r.frequency for r in rows] == [0, 1, 2, 3, 4]
    n = inputs.count()
    assert sum(r.actual for r in rows) == n and sum(r.expected for r in rows) == pytest.approx(n)


def test_formula_clv_function_names(spark):
    from custval.plans.retail import clv_formula_retail

    cols = clv_formula_retail(invoice_lines(spark, SF_SMALL), names="function").columns
    assert "avg_order_value" in cols and "cltv" in cols and "clv" not in cols
