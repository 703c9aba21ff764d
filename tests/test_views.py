"""The fixture views reproduce the sizes stated in FIXTURES.md."""

from __future__ import annotations

from conftest import SF_SMALL
from pyspark.sql import functions as F

from custval.operators.filters import drop_cancelled, drop_nulls
from custval.operators.rfm import customer_activity, with_line_total
from custval.sources.tables import customer_summary, invoice_lines


def test_invoice_view_customers(spark):
    lines = invoice_lines(spark, SF_SMALL)
    assert lines.columns == [
        "Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"
    ]
    activity = customer_activity(drop_cancelled(drop_nulls(with_line_total(lines))))
    assert activity.count() == 150
    assert activity.filter(F.col("frequency") == 1).count() == 1


def test_summary_view(spark):
    summary = customer_summary(spark, SF_SMALL)
    assert summary.count() == 150
    row = summary.agg(
        F.count_distinct("master_id").alias("ids"),
        F.min(F.col("order_num_total_ever_online") + F.col("order_num_total_ever_offline")).alias("min_orders"),
        F.count_if(F.col("interested_in_categories_12").rlike(r"^\[.*\]$")).alias("lists"),
        F.count_if(F.col("interested_in_categories_12").isNull()).alias("no_list"),
    ).collect()[0]
    assert row["ids"] == 150 and row["min_orders"] >= 1
    assert row["lists"] + row["no_list"] == 150
