"""Recency / frequency / monetary metrics, scores and segments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custval.functions.dates import days_between, ntz_literal
from custval.functions.segments import score_string, segment_of
from custval.operators.quantiles import Cut, qcut_many
from custval.operators.reports import group_report

RECENCY_LABELS = (5, 4, 3, 2, 1)
SCORE_LABELS = (1, 2, 3, 4, 5)


def with_line_total(
    lines: DataFrame, quantity: str = "Quantity", price: str = "Price", out: str = "TotalPrice"
) -> DataFrame:
    return lines.withColumn(out, F.col(quantity) * F.col(price))


def customer_activity(
    lines: DataFrame,
    customer: str = "Customer ID",
    invoice: str = "Invoice",
    date: str = "InvoiceDate",
    amount: str = "TotalPrice",
    money_decimals: int | None = 2,
) -> DataFrame:
    """Per customer: last invoice date, distinct invoices, total amount.

    One hash aggregation keyed by customer (Spark adds the (customer, invoice)
    stage for the distinct count); partial aggregation before each shuffle
    keeps a customer with a huge share of the lines from landing whole on one
    task.  ``monetary`` is rounded to ``money_decimals`` so the summation order
    of the partial sums cannot move a customer across a quantile cut.
    """
    monetary = F.sum(amount)
    if money_decimals is not None:
        monetary = F.round(monetary, money_decimals)
    return (
        lines.filter(F.col(customer).isNotNull())
        .groupBy(F.col(customer).alias("customer_id"))
        .agg(
            F.max(date).alias("last_date"),
            F.count_distinct(invoice).alias("frequency"),
            monetary.alias("monetary"),
        )
    )


def with_recency(activity: DataFrame, analysis_date: dt.datetime) -> DataFrame:
    """recency = whole days from the last invoice to the analysis date."""
    return activity.select(
        "customer_id",
        days_between(ntz_literal(analysis_date), F.col("last_date")).alias("recency"),
        "frequency",
        "monetary",
    )


def rfm_metrics(
    lines: DataFrame,
    analysis_date: dt.datetime,
    customer: str = "Customer ID",
    invoice: str = "Invoice",
    date: str = "InvoiceDate",
    amount: str = "TotalPrice",
    money_decimals: int | None = 2,
) -> DataFrame:
    """Per customer: recency (days), frequency (distinct invoices), monetary."""
    activity = customer_activity(lines, customer, invoice, date, amount, money_decimals)
    return with_recency(activity, analysis_date)


def rfm_scores(
    rfm: DataFrame,
    key: str = "customer_id",
    q: int = 5,
    mapping: dict[str, str] | None = None,
    rows_per_partition: int | None = None,
    counts: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Add 1..5 scores, the RF/RFM score strings and the segment.

    ``counts`` (see :func:`~custval.operators.quantiles.qcut_many`) saves the job that counts the rows.

    recency: qcut with reversed labels (recent = 5); frequency: qcut of the
    unique rank (ties broken by ``key``); monetary: qcut.
    """
    cuts = [
        Cut("recency", q, list(range(q, 0, -1)), "recency_score"),
        Cut("frequency", q, list(range(1, q + 1)), "frequency_score", by_rank=True),
        Cut("monetary", q, list(range(1, q + 1)), "monetary_score"),
    ]
    scored = qcut_many(rfm, cuts, key, rows_per_partition, counts)
    return scored.withColumns(
        {
            "RF_SCORE": score_string("recency_score", "frequency_score"),
            "RFM_SCORE": score_string("recency_score", "frequency_score", "monetary_score"),
        }
    ).withColumn("segment", segment_of("RF_SCORE", mapping, 2, q))


def segment_report(rfm: DataFrame, segment: str = "segment") -> DataFrame:
    """Mean and count of recency, frequency and monetary per segment."""
    return group_report(rfm, segment, ["recency", "frequency", "monetary"], ("mean", "count"))


def segment_ids(
    rfm: DataFrame, segment_name: str, key: str = "customer_id", out: str = "new_customer_id"
) -> DataFrame:
    """Ids of one segment's customers as integers."""
    return rfm.filter(F.col("segment") == segment_name).select(F.col(key).cast("long").alias(out))
