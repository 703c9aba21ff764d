"""Named queries over the benchmark tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame; together they
cover the operator inventory.  Every query reads the given tables (or tables
Spark derives from them), in full.  Floating results are rounded in the
output so that they compare stably with an independent SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custval.functions.dates import days_between, ntz_literal, to_timestamp_columns
from custval.functions.numeric import sig_round
from custval.functions.segments import BRAND_CAMPAIGN_SEGMENTS, DISCOUNT_CAMPAIGN_SEGMENTS
from custval.operators.bgnbd import BetaGeoParams, fit_bgnbd
from custval.operators.bgnbd import grouped_inputs as bgnbd_groups
from custval.operators.bgnbd import objective_values as bgnbd_values
from custval.operators.clv import clv_base as clv_base_op
from custval.operators.clv import clv_rates as clv_rates_op
from custval.operators.filters import keep_value_or_no_orders
from custval.operators.gammagamma import (
    GammaGammaParams,
    discounted_clv,
    expected_average_profit,
    fit_gamma_gamma,
)
from custval.operators.gammagamma import grouped_inputs as gamma_gamma_groups
from custval.operators.gammagamma import objective_values as gamma_gamma_values
from custval.operators.kpi import acquisition, conversion, retention
from custval.operators.order_stats import global_rank
from custval.operators.outliers import cap_both_rounded, outlier_thresholds
from custval.operators.profile import (
    describe,
    distinct_counts,
    distinct_values,
    null_counts,
    value_counts,
)
from custval.operators.quantiles import qcut
from custval.operators.reports import (
    channel_rollup,
    first_rows,
    group_report,
    invoice_bills,
    top_k,
)
from custval.operators.reports import invoice_totals as invoice_totals_op
from custval.operators.filters import drop_cancelled, drop_nulls
from custval.operators.rfm import (
    customer_activity,
    segment_ids,
    segment_report,
    with_line_total,
    with_recency,
)
from custval.plans.omni import (
    CAP_COLUMNS,
    CATEGORY_COL,
    campaign_targets,
    data_prep,
    model_inputs_omni,
    rfm_omni,
    targets_by_ids,
)
from custval.plans.predict import (
    OMNI_COLS,
    OMNI_HORIZONS,
    RETAIL_HORIZONS,
    clv_predict_omni,
    clv_predict_retail,
    fit_table,
    merge_by_key,
    score_customers,
    split_top_segment,
)
from custval.plans.predict import calibration as calibration_op
from custval.plans.retail import (
    clv_formula_retail,
    clv_prepared_lines,
    model_inputs_retail,
    model_lines,
    rfm_retail,
)
from custval.session import materialize
from custval.sources.tables import INVOICE_COLUMNS, customer_summary, default_analysis_date, invoice_lines, read_table

Query = Callable[[SparkSession, str], DataFrame]
SIG_DIGITS = 10


def rounded(df: DataFrame, digits: int = SIG_DIGITS) -> DataFrame:
    """Round every double column to significant digits.

    Used for aggregates whose floating value depends on the summation order
    (sums, means, deviations); row-level formulas are returned unrounded.
    """
    return df.select(
        *[
            sig_round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )


# --- retail RFM -----------------------------------------------------------


def rfm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rfm = rfm_retail(invoice_lines(spark, sf_dir))
    return rfm.select("customer_id", "recency", "frequency", "monetary")


def rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rfm = rfm_retail(invoice_lines(spark, sf_dir))
    return rfm.select(
        "customer_id",
        "recency_score",
        "frequency_score",
        "monetary_score",
        "RF_SCORE",
        "RFM_SCORE",
    )


def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm_retail(invoice_lines(spark, sf_dir), keep_scores=False)


def rfm_segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segment_report(rfm_retail(invoice_lines(spark, sf_dir))))


def new_customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_ids(rfm_retail(invoice_lines(spark, sf_dir)), "new_customers")


# --- profiling and invoice reports -----------------------------------------


def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = invoice_lines(spark, sf_dir, ["Invoice", "Quantity", "Price"])
    return rounded(invoice_totals_op(with_line_total(lines)))


def invoice_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_bills(invoice_lines(spark, sf_dir, ["Invoice", "Quantity", "Price"]))


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_counts(invoice_lines(spark, sf_dir))


def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """describe() of the per-customer metrics, before the monetary > 0 filter."""
    lines = drop_cancelled(drop_nulls(with_line_total(invoice_lines(spark, sf_dir))))
    activity = materialize(customer_activity(lines), "customer_activity")
    metrics = with_recency(activity, default_analysis_date(activity, "last_date"))
    return rounded(describe(metrics, ["recency", "frequency", "monetary"], key="customer_id"))


def latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest invoice date and latest order date of the summary (as text)."""
    none = F.lit(None).cast("timestamp_ntz")
    lines = invoice_lines(spark, sf_dir, ["InvoiceDate"]).select(F.col("InvoiceDate").alias("i"), none.alias("o"))
    orders = read_table(spark, sf_dir, "orders").where("o_custkey is not null")  # the summary's orders
    both = lines.unionByName(orders.select(none.alias("i"), F.col("o_orderdate").alias("o"))).agg(
        F.max("i").alias("latest_invoice_date"), F.max("o").alias("latest_order_date")
    )
    return _dates_as_text(both)


def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = invoice_lines(spark, sf_dir, ["Invoice"]).agg(F.count("*").alias("rows"))
    return rows.withColumn("columns", F.lit(len(INVOICE_COLUMNS)))


def distinct_count_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["Invoice", "StockCode", "Description", "Customer ID"]
    return reduce(DataFrame.unionByName, [distinct_counts(invoice_lines(spark, sf_dir, [c]), [c]) for c in columns])


def frequency_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unique ascending rank behind the frequency score (ties by customer)."""
    rfm = rfm_retail(invoice_lines(spark, sf_dir))
    return global_rank(
        rfm.select("customer_id", "frequency"), ["frequency", "customer_id"], "frequency_rank"
    )


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(rfm_retail(invoice_lines(spark, sf_dir)), "segment")


# --- formula CLV --------------------------------------------------------------

CLV_MEASURES = [
    "total_transaction",
    "total_unit",
    "total_price",
    "average_order_value",
    "purchase_frequency",
    "profit_margin",
    "customer_value",
    "clv",
]


def clv_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clv_base_op(clv_prepared_lines(invoice_lines(spark, sf_dir)))


def clv_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clv_rates_op(clv_base_op(clv_prepared_lines(invoice_lines(spark, sf_dir)))))


def clv_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clv_formula_retail(invoice_lines(spark, sf_dir))


def clv_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    clv = clv_formula_retail(invoice_lines(spark, sf_dir))
    return clv.select("customer_id", "clv", "segment")


def clv_segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    clv = clv_formula_retail(invoice_lines(spark, sf_dir))
    return model_rounded(group_report(clv, "segment", CLV_MEASURES))


def clv_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    clv = clv_formula_retail(invoice_lines(spark, sf_dir))
    return top_k(clv, "clv", 10, "customer_id")


def clv_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    clv = clv_formula_retail(invoice_lines(spark, sf_dir))
    return top_k(clv, "clv", 5, "customer_id", ascending=True)


# --- customer summary (omnichannel) ----------------------------------------

OMNI_CAP_COLUMNS = list(CAP_COLUMNS)
# Stand-ins for the reference's category words: the part types of the tables.
BRAND_CATEGORIES = ("PROMO",)
DISCOUNT_CATEGORIES = ("SMALL", "ECONOMY")


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t.startswith("timestamp")})


def omni_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates_as_text(data_prep(customer_summary(spark, sf_dir)))


def omni_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm_omni(customer_summary(spark, sf_dir)).drop(CATEGORY_COL)


def omni_segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segment_report(rfm_omni(customer_summary(spark, sf_dir))))


def omni_channel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(channel_rollup(data_prep(customer_summary(spark, sf_dir))))


def omni_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = data_prep(customer_summary(spark, sf_dir))
    top = top_k(prepared, "customer_value_total", 10, "master_id")
    return top.select("master_id", "customer_value_total", "order_num_total")


def omni_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = data_prep(customer_summary(spark, sf_dir))
    top = top_k(prepared, "order_num_total", 10, "master_id")
    return top.select("master_id", "order_num_total", "customer_value_total")


def campaign_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rfm = rfm_omni(customer_summary(spark, sf_dir))
    return campaign_targets(rfm, BRAND_CAMPAIGN_SEGMENTS, BRAND_CATEGORIES)


def campaign_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rfm = rfm_omni(customer_summary(spark, sf_dir))
    return campaign_targets(rfm, DISCOUNT_CAMPAIGN_SEGMENTS, DISCOUNT_CATEGORIES)


def targets_by_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary rows of the brand campaign's ids (a left semi-join with an id list)."""
    summary = materialize(customer_summary(spark, sf_dir), "omni_summary")
    ids = campaign_targets(rfm_omni(summary), BRAND_CAMPAIGN_SEGMENTS, BRAND_CATEGORIES, out="customer_id")
    return targets_by_ids(summary, ids).select("master_id", "order_channel", "last_order_channel")


def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written as text and parsed back by the preparation step: days from first to last order."""
    orders = read_table(spark, sf_dir, "orders").where("o_custkey is not null")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = orders.groupBy("o_custkey").agg(F.min(day).alias("first_order_date"), F.max(day).alias("last_order_date"))
    parsed = to_timestamp_columns(text, "date")
    return parsed.select("o_custkey", days_between("last_order_date", "first_order_date").alias("days"))


def category_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(customer_summary(spark, sf_dir), CATEGORY_COL)


def zero_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keep_value_or_no_orders(data_prep(customer_summary(spark, sf_dir)))
    return kept.select("master_id", "order_num_total", "customer_value_total")


def _limits_frame(spark: SparkSession, limits: dict, rounded_caps: bool) -> DataFrame:
    rows = []
    for c, (low, up) in limits.items():
        row = (c, float(low), float(up))
        if rounded_caps:
            row += (float(round(low, 0)), float(round(up, 0)))
        rows.append(row)
    schema = "column_name string, low_limit double, up_limit double"
    if rounded_caps:
        schema += ", low_cap double, up_cap double"
    # one row per capped column
    return spark.createDataFrame(rows, schema)


def caps_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = outlier_thresholds(model_lines(invoice_lines(spark, sf_dir)), ["Quantity", "Price"])
    return rounded(_limits_frame(spark, limits, False))


def caps_both_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = customer_summary(spark, sf_dir)
    limits = outlier_thresholds(summary, OMNI_CAP_COLUMNS, key="master_id")
    return rounded(_limits_frame(spark, limits, True))


def omni_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped, _ = cap_both_rounded(customer_summary(spark, sf_dir), OMNI_CAP_COLUMNS, key="master_id")
    return capped.select("master_id", *OMNI_CAP_COLUMNS)


# --- probabilistic models --------------------------------------------------

# Published example parameters (CDNOW data set) used to check the
# prediction formulas independently of any fit.
CDNOW_BGNBD = BetaGeoParams(r=0.243, alpha=4.414, a=0.793, b=2.426)
CDNOW_GAMMA_GAMMA = GammaGammaParams(p=6.25, q=3.74, v=15.44)
STEEP_BGNBD = BetaGeoParams(r=1.7, alpha=9.0, a=6.2, b=8.1)
BGNBD_POINTS = (CDNOW_BGNBD, STEEP_BGNBD, BetaGeoParams(r=0.05, alpha=0.4, a=0.02, b=0.3), BetaGeoParams(r=3.0, alpha=30.0, a=1.0, b=20.0))
GAMMA_GAMMA_POINTS = (CDNOW_GAMMA_GAMMA, GammaGammaParams(p=1.0, q=1.5, v=100.0), GammaGammaParams(p=0.3, q=0.2, v=2.0))
MODEL_DIGITS = 8
CALIBRATION_MAX = 7


def model_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, MODEL_DIGITS)


def clv_model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model_inputs_retail(invoice_lines(spark, sf_dir)))


def omni_model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model_inputs_omni(customer_summary(spark, sf_dir)))


def _retail_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_inputs_retail(invoice_lines(spark, sf_dir))


def bgnbd_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _retail_inputs(spark, sf_dir)
    scored = score_customers(inputs, CDNOW_BGNBD, CDNOW_GAMMA_GAMMA)
    return model_rounded(scored.select("customer_id", *RETAIL_HORIZONS))


def _gg_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _retail_inputs(spark, sf_dir)
    profit = expected_average_profit(CDNOW_GAMMA_GAMMA, "frequency", "monetary")
    return inputs.select("customer_id", profit.alias("expected_average_profit"))


def gg_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rounded(_gg_profit(spark, sf_dir))


def clv_discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _retail_inputs(spark, sf_dir)
    clv = discounted_clv(
        CDNOW_BGNBD, CDNOW_GAMMA_GAMMA, "frequency", "recency", "T", "monetary", 3, 0.01, "W"
    )
    return model_rounded(inputs.select("customer_id", clv.alias("clv")))


def clv_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted CLV of customers with three transactions or more, merged onto all customers."""
    inputs = _retail_inputs(spark, sf_dir)
    clv = discounted_clv(CDNOW_BGNBD, CDNOW_GAMMA_GAMMA, "frequency", "recency", "T", "monetary", 3, 0.01, "W")
    some = inputs.where("frequency >= 3").select("customer_id", clv.alias("clv"))
    return model_rounded(merge_by_key(inputs.select("customer_id", "frequency"), some, "customer_id"))


def preview_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a preview of the invoice lines holds (which rows it shows is left open)."""
    return first_rows(invoice_lines(spark, sf_dir, ["Invoice"]), 5).agg(F.count("*").alias("rows"))


def expected_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _retail_inputs(spark, sf_dir)
    scored = score_customers(inputs, CDNOW_BGNBD, CDNOW_GAMMA_GAMMA)
    return model_rounded(
        scored.agg(
            F.count("*").alias("customers"),
            F.sum("expected_purc_1_month").alias("expected_purc_1_month_total"),
            F.sum("expected_purc_3_month").alias("expected_purc_3_month_total"),
        )
    )


def _omni_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = model_inputs_omni(customer_summary(spark, sf_dir))
    return score_customers(inputs, CDNOW_BGNBD, CDNOW_GAMMA_GAMMA, OMNI_COLS, OMNI_HORIZONS, "exp_average_value", 6)


def _omni_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialize(_omni_scored(spark, sf_dir).select("customer_id", "clv"), "clv_scored")
    return split_top_segment(qcut(scored, "clv", 4, ["D", "C", "B", "A"], "clv_segment", "customer_id"))


def sub_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rounded(_omni_segmented(spark, sf_dir))


def top_expected_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 customers with the most expected purchases in 3 months (omni inputs)."""
    scored = _omni_scored(spark, sf_dir).select("customer_id", "exp_sales_3_month")
    return model_rounded(top_k(scored, "exp_sales_3_month", 10, "customer_id"))


def top_expected_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 customers with the highest expected average profit (retail inputs)."""
    profit = _gg_profit(spark, sf_dir)
    return model_rounded(top_k(profit, "expected_average_profit", 10, "customer_id"))


PREDICTION_MEASURES = [
    "expected_purc_1_week",
    "expected_purc_1_month",
    "expected_purc_3_month",
    "expected_average_profit",
    "clv",
]


def predicted_clv_segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count / mean / sum of the predictions per CLV quartile (retail inputs)."""
    inputs = _retail_inputs(spark, sf_dir)
    scored = score_customers(inputs, CDNOW_BGNBD, CDNOW_GAMMA_GAMMA)
    scored = materialize(scored.select("customer_id", *PREDICTION_MEASURES), "clv_scored")
    segmented = qcut(scored, "clv", 4, ["D", "C", "B", "A"], "segment", "customer_id")
    return model_rounded(group_report(segmented, "segment", PREDICTION_MEASURES))


def omni_clv_segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    segmented = _omni_segmented(spark, sf_dir)
    return model_rounded(group_report(segmented, "clv_segment", ["clv"], ("count", "mean")))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per transaction count: observed vs expected under the model."""
    return model_rounded(calibration_op(CDNOW_BGNBD, _retail_inputs(spark, sf_dir), CALIBRATION_MAX))


def bgnbd_score_steep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected purchases with a large dropout shape (a > 5)."""
    scored = score_customers(_retail_inputs(spark, sf_dir), STEEP_BGNBD, CDNOW_GAMMA_GAMMA)
    return model_rounded(scored.select("customer_id", *RETAIL_HORIZONS))


def _objective_rows(spark: SparkSession, values: list[tuple[float, object]]) -> DataFrame:
    """One row per point: the fit's penalised objective."""
    return spark.createDataFrame([(i, float(f)) for i, (f, _) in enumerate(values)], "point int, objective double")


def bgnbd_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalised BG/NBD objective at fixed parameters (times in weeks, not scaled)."""
    grouped = bgnbd_groups(_retail_inputs(spark, sf_dir), "frequency", "recency", "T", 1.0)
    return model_rounded(_objective_rows(spark, bgnbd_values(grouped, BGNBD_POINTS, 0.001)))


def gg_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalised Gamma-Gamma objective at fixed parameters."""
    grouped = gamma_gamma_groups(_retail_inputs(spark, sf_dir), "frequency", "monetary")
    return model_rounded(_objective_rows(spark, gamma_gamma_values(grouped, GAMMA_GAMMA_POINTS, 0.01)))


def clv_pipeline_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted-CLV pipeline after the fits, at fixed parameters: scores and quartiles."""
    scored = materialize(score_customers(_retail_inputs(spark, sf_dir), CDNOW_BGNBD, CDNOW_GAMMA_GAMMA), "clv_scored")
    segmented = qcut(scored, "clv", 4, ["D", "C", "B", "A"], "segment", "customer_id")
    return model_rounded(segmented.select("customer_id", *PREDICTION_MEASURES, "segment"))


def clv_pipeline_omni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The omnichannel pipeline after the fits, at fixed parameters: scores and quartiles."""
    scored = materialize(_omni_scored(spark, sf_dir), "clv_scored")
    segmented = qcut(scored, "clv", 4, ["D", "C", "B", "A"], "clv_segment", "customer_id")
    return model_rounded(segmented.select("customer_id", *OMNI_HORIZONS, "exp_average_value", "clv", "clv_segment"))


def bgnbd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _retail_inputs(spark, sf_dir)
    return fit_table(spark, fit_bgnbd(inputs, "frequency", "recency", "T", 0.001), "bgnbd")


def gg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _retail_inputs(spark, sf_dir)
    return fit_table(spark, fit_gamma_gamma(inputs, "frequency", "monetary", 0.01), "gamma_gamma")


def clv_predict_retail_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clv_predict_retail(invoice_lines(spark, sf_dir)).table


def clv_predict_omni_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clv_predict_omni(customer_summary(spark, sf_dir)).table


# --- events and KPIs ---------------------------------------------------------


def event_recency_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: whole days from the last purchase event to the analysis date.

    Event timestamps carry times of day, so this exercises the floor-of-days
    rule (not calendar days, not truncation toward zero).
    """
    events = read_table(spark, sf_dir, "events")
    per_user = materialize(
        events.filter((F.col("event_type") == "purchase") & F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.max("ts").alias("last_ts"),
            F.count("*").alias("purchases"),
            F.round(F.sum("value"), 2).alias("value"),
        ),
        "event_purchases",
    )
    analysis_date = default_analysis_date(per_user, "last_ts")
    return per_user.select(
        "user_id",
        days_between(ntz_literal(analysis_date), F.col("last_ts")).alias("recency"),
        "purchases",
        "value",
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")


def kpi_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquisition(_orders(spark, sf_dir), "o_custkey", "o_orderdate"))


def kpi_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retention(_orders(spark, sf_dir), "o_custkey", "o_orderdate"))


def kpi_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis = retention(_orders(spark, sf_dir), "o_custkey", "o_orderdate")
    return rounded(kpis.select("period", "churn_rate"))


def kpi_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conversion(read_table(spark, sf_dir, "events")))


QUERIES: dict[str, Query] = {
    "rfm_metrics": rfm_metrics,
    "rfm_scores": rfm_scores,
    "rfm_segments": rfm_segments,
    "rfm_segment_report": rfm_segment_report,
    "new_customer_ids": new_customer_ids,
    "invoice_totals": invoice_totals,
    "invoice_bill": invoice_bill,
    "null_profile": null_profile,
    "numeric_summary": numeric_summary,
    "distinct_counts": distinct_count_profile,
    "latest_dates": latest_dates,
    "table_shape": table_shape,
    "segment_counts": segment_counts,
    "frequency_ranks": frequency_ranks,
    "clv_base": clv_base,
    "clv_rates": clv_rates,
    "clv_formula": clv_formula,
    "clv_segments": clv_segments,
    "clv_segment_report": clv_segment_report,
    "clv_top": clv_top,
    "clv_bottom": clv_bottom,
    "omni_prep": omni_prep,
    "omni_rfm": omni_rfm,
    "omni_segment_report": omni_segment_report,
    "omni_channel_report": omni_channel_report,
    "omni_top_customers": omni_top_customers,
    "omni_top_orders": omni_top_orders,
    "campaign_brand": campaign_brand,
    "campaign_discount": campaign_discount,
    "zero_value_filter": zero_value_filter,
    "category_values": category_values,
    "targets_by_ids": targets_by_id_list,
    "text_dates": text_dates,
    "caps_upper": caps_upper,
    "caps_both_rounded": caps_both_rounded,
    "omni_capped": omni_capped,
    "clv_model_inputs": clv_model_inputs,
    "omni_model_inputs": omni_model_inputs,
    "bgnbd_score": bgnbd_score,
    "gg_profit": gg_profit,
    "clv_discounted": clv_discounted,
    "clv_merged": clv_merged,
    "preview_size": preview_size,
    "expected_total": expected_total,
    "sub_segments": sub_segments,
    "omni_clv_segment_report": omni_clv_segment_report,
    "predicted_clv_segment_report": predicted_clv_segment_report,
    "top_expected_sales": top_expected_sales,
    "top_expected_profit": top_expected_profit,
    "calibration": calibration,
    "bgnbd_score_steep": bgnbd_score_steep,
    "bgnbd_objective": bgnbd_objective,
    "gg_objective": gg_objective,
    "clv_pipeline_retail": clv_pipeline_retail,
    "clv_pipeline_omni": clv_pipeline_omni,
    "bgnbd_fit": bgnbd_fit,
    "gg_fit": gg_fit,
    "clv_predict_retail": clv_predict_retail_q,
    "clv_predict_omni": clv_predict_omni_q,
    "event_recency_days": event_recency_days,
    "kpi_acquisition": kpi_acquisition,
    "kpi_retention": kpi_retention,
    "kpi_churn": kpi_churn,
    "kpi_conversion": kpi_conversion,
}
