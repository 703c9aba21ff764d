"""Customer-summary (omnichannel) pipelines: preparation, RFM, campaigns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custval.functions.dates import days_between, ntz_literal, to_timestamp_columns
from custval.functions.segments import (
    BRAND_CAMPAIGN_CATEGORIES,
    BRAND_CAMPAIGN_SEGMENTS,
    DISCOUNT_CAMPAIGN_CATEGORIES,
    DISCOUNT_CAMPAIGN_SEGMENTS,
)
from custval.operators.filters import (
    in_segments,
    keep_value_or_no_orders,
    mentions_any,
    repeat_customers,
)
from custval.operators.outliers import cap_both_rounded
from custval.operators.rfm import rfm_scores
from custval.session import materialize
from custval.sources.tables import default_analysis_date

CATEGORY_COL = "interested_in_categories_12"


def data_prep(summary: DataFrame) -> DataFrame:
    """Add order/value totals over both channel sides; parse date columns."""
    prepared = summary.withColumns(
        {
            "order_num_total": F.col("order_num_total_ever_online")
            + F.col("order_num_total_ever_offline"),
            "customer_value_total": F.col("customer_value_total_ever_offline")
            + F.col("customer_value_total_ever_online"),
        }
    )
    return to_timestamp_columns(prepared, "date")


def omni_rfm_metrics(prepared: DataFrame, analysis_date: dt.datetime) -> DataFrame:
    """One row per customer already: a projection, no aggregation."""
    return prepared.select(
        F.col("master_id").alias("customer_id"),
        days_between(ntz_literal(analysis_date), F.col("last_order_date")).alias("recency"),
        F.col("order_num_total").alias("frequency"),
        F.col("customer_value_total").alias("monetary"),
        F.col(CATEGORY_COL),
    )


def rfm_omni(
    summary: DataFrame,
    analysis_date: dt.datetime | None = None,
    mapping: dict[str, str] | None = None,
    rows_per_partition: int | None = None,
) -> DataFrame:
    """RFM scores and segments of the customer summary.

    Output: customer_id, recency, frequency, monetary, RF_SCORE, RFM_SCORE,
    segment, and the category list (kept for the campaign filters, so target
    lists need no join back to the summary).
    """
    prepared = materialize(data_prep(summary), "omni_prepared")
    if analysis_date is None:
        analysis_date = default_analysis_date(prepared, "last_order_date")
    scored = rfm_scores(
        omni_rfm_metrics(prepared, analysis_date), "customer_id", mapping=mapping,
        rows_per_partition=rows_per_partition,
    )
    return scored.select(
        "customer_id",
        "recency",
        "frequency",
        "monetary",
        "recency_score",
        "frequency_score",
        "monetary_score",
        "RF_SCORE",
        "RFM_SCORE",
        "segment",
        CATEGORY_COL,
    )


def campaign_targets(
    rfm: DataFrame,
    segments: Sequence[str],
    categories: Sequence[str],
    key: str = "customer_id",
    out: str = "master_id",
) -> DataFrame:
    """Ids of customers in ``segments`` whose category list mentions any category.

    The category list travels with the RFM rows (same customers, one row
    each), so the target list is a filter - no semi-join back to the summary.
    """
    targets = in_segments(rfm, segments).filter(mentions_any(CATEGORY_COL, categories))
    return targets.select(F.col(key).alias(out))


def targets_by_ids(summary: DataFrame, ids: DataFrame, key: str = "master_id", id_col: str = "customer_id") -> DataFrame:
    """Rows of ``summary`` whose key is among ``ids`` (a left semi-join).

    For id lists that come from another table; Catalyst/AQE pick the join
    strategy from the measured sizes.
    """
    return summary.join(ids.select(F.col(id_col).alias(key)), key, "left_semi")


def brand_campaign(rfm: DataFrame, categories: Sequence[str] = BRAND_CAMPAIGN_CATEGORIES) -> DataFrame:
    return campaign_targets(rfm, BRAND_CAMPAIGN_SEGMENTS, categories)


def discount_campaign(
    rfm: DataFrame, categories: Sequence[str] = DISCOUNT_CAMPAIGN_CATEGORIES
) -> DataFrame:
    return campaign_targets(rfm, DISCOUNT_CAMPAIGN_SEGMENTS, categories)


CAP_COLUMNS = (
    "order_num_total_ever_online",
    "order_num_total_ever_offline",
    "customer_value_total_ever_offline",
    "customer_value_total_ever_online",
)


def model_inputs_omni(
    summary: DataFrame,
    analysis_date: dt.datetime | None = None,
    repeat_only: bool = True,
) -> DataFrame:
    """BG/NBD / Gamma-Gamma inputs from the customer summary.

    The four count/value columns are capped at the rounded outlier limits,
    totals are added, rows with a zero value but some orders are dropped
    (``repeat_only``, with frequency > 1, as the function form does), and the
    weekly recency / age and the mean order value are derived.
    """
    # the thresholds and the capping read the summary again: compute it once
    summary = materialize(summary, "omni_summary")
    capped, _ = cap_both_rounded(summary, list(CAP_COLUMNS), key="master_id")
    prepared = data_prep(capped)
    if repeat_only:
        prepared = keep_value_or_no_orders(prepared)
    prepared = materialize(prepared, "omni_model_prepared")
    if analysis_date is None:
        analysis_date = default_analysis_date(prepared, "last_order_date")
    inputs = prepared.select(
        F.col("master_id").alias("customer_id"),
        (days_between("last_order_date", "first_order_date") / F.lit(7.0)).alias("recency_clv_weekly"),
        (days_between(ntz_literal(analysis_date), F.col("first_order_date")) / F.lit(7.0)).alias(
            "T_weekly"
        ),
        F.col("order_num_total").alias("frequency"),
        F.try_divide(F.col("customer_value_total"), F.col("order_num_total")).alias("monetary_clv_avg"),
    )
    return repeat_customers(inputs) if repeat_only else inputs
