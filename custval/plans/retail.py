"""Invoice-line pipelines: RFM, formula CLV and predicted CLV."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custval.operators.clv import clv_base, clv_formula
from custval.operators.filters import drop_cancelled, drop_nulls, positive, repeat_customers
from custval.operators.outliers import cap_upper
from custval.operators.quantiles import qcut
from custval.functions.dates import days_between, ntz_literal
from custval.operators.rfm import customer_activity, rfm_scores, with_line_total, with_recency
from custval.session import materialize, materialize_observed
from custval.sources.sinks import write_table
from custval.sources.tables import date_after


def rfm_retail(
    lines: DataFrame,
    analysis_date: dt.datetime | None = None,
    keep_scores: bool = True,
    mapping: dict[str, str] | None = None,
    rows_per_partition: int | None = None,
    output_path: str | None = None,
) -> DataFrame:
    """RFM segments from invoice lines (written as CSV too when ``output_path`` is set).

    line total -> drop rows with any null -> drop cancelled invoices ->
    per-customer metrics -> keep monetary > 0 -> scores -> segment.
    The per-customer table is materialised once (the quantile cuts read it again; the
    raw lines are scanned once); the analysis date and the cuts' counts are observed
    while it is written.
    """
    prepared = drop_cancelled(drop_nulls(with_line_total(lines)))
    paid = F.col("monetary") > 0
    measured = {"recency": F.to_date("last_date"), "frequency": F.col("frequency"), "monetary": F.col("monetary")}
    seen = {f"n_{c}": F.count_if(paid & x.isNotNull()) for c, x in measured.items()}
    seen |= {f"d_{c}": F.approx_count_distinct(F.when(paid, x)) for c, x in measured.items()}
    activity, found = materialize_observed(customer_activity(prepared), "customer_activity", latest=F.max("last_date"), **seen)
    if analysis_date is None:
        analysis_date = date_after(found["latest"], "last_date")
    metrics = with_recency(activity, analysis_date).filter("monetary > 0")
    counts = {c: (found[f"n_{c}"], found[f"d_{c}"]) for c in measured}
    scored = rfm_scores(metrics, mapping=mapping, rows_per_partition=rows_per_partition, counts=counts)
    if not keep_scores:
        scored = scored.select("customer_id", "recency", "frequency", "monetary", "segment")
    if output_path is not None:
        write_table(scored, output_path, "csv")
    return scored


CLV_LABELS = ("D", "C", "B", "A")
# Column names of the function form of the formula CLV.
FUNCTION_NAMES = {"average_order_value": "avg_order_value", "clv": "cltv"}


def clv_prepared_lines(lines: DataFrame) -> DataFrame:
    """Lines kept by the CLV pipelines: not cancelled, quantity > 0, no nulls."""
    return with_line_total(drop_nulls(positive(drop_cancelled(lines), "Quantity")))


def clv_formula_retail(
    lines: DataFrame,
    profit: float = 0.10,
    q: int = 4,
    labels=CLV_LABELS,
    rows_per_partition: int | None = None,
    names: str = "script",
) -> DataFrame:
    """Formula CLV per customer plus quartile segments (D lowest ... A highest).

    ``names="function"`` uses the function form's column names
    (``avg_order_value``, ``cltv``) instead of the script's
    (``average_order_value``, ``clv``).
    """
    base = materialize(clv_base(clv_prepared_lines(lines)), "clv_base")
    out = qcut(
        clv_formula(base, profit), "clv", q, list(labels), "segment", "customer_id",
        rows_per_partition=rows_per_partition,
    )
    if names == "function":
        out = out.withColumnsRenamed(FUNCTION_NAMES)
    elif names != "script":
        raise ValueError(f"names must be 'script' or 'function', not {names!r}")
    return out


def model_lines(lines: DataFrame) -> DataFrame:
    """Lines kept by the predicted-CLV pipeline (before capping).

    no nulls -> not cancelled -> quantity > 0 -> price > 0.
    """
    return positive(drop_cancelled(drop_nulls(lines)), "Quantity", "Price")


def model_inputs_retail(
    lines: DataFrame,
    analysis_date: dt.datetime | None = None,
    cap: bool = True,
    repeat_only: bool = True,
    money_decimals: int | None = 2,
) -> DataFrame:
    """BG/NBD / Gamma-Gamma inputs per customer from invoice lines.

    Quantity and Price are capped at q99 + 1.5 IQR (thresholds over the kept
    lines).  recency = days between first and last invoice, T = days from the
    first invoice to the analysis date, both in weeks; frequency = distinct
    invoices; monetary = total spend per invoice.  The lines are read again, pruned,
    for the thresholds and for the aggregation: they are never written.
    """
    kept = model_lines(lines).select("Customer ID", "Invoice", "InvoiceDate", "Quantity", "Price")
    if cap:
        kept, _ = cap_upper(kept, ["Quantity", "Price"])
    kept = with_line_total(kept)
    total = F.sum("TotalPrice")
    if money_decimals is not None:
        total = F.round(total, money_decimals)
    per_customer, found = materialize_observed(
        kept.groupBy(F.col("Customer ID").alias("customer_id")).agg(
            F.min("InvoiceDate").alias("first_date"),
            F.max("InvoiceDate").alias("last_date"),
            F.count_distinct("Invoice").alias("frequency"),
            total.alias("total"),
        ),
        "model_customers",
        latest=F.max("last_date"),
    )
    if analysis_date is None:
        analysis_date = date_after(found["latest"], "last_date")
    inputs = per_customer.select(
        "customer_id",
        (days_between("last_date", "first_date") / F.lit(7.0)).alias("recency"),
        (days_between(ntz_literal(analysis_date), F.col("first_date")) / F.lit(7.0)).alias("T"),
        "frequency",
        (F.col("total") / F.col("frequency")).alias("monetary"),
    )
    return repeat_customers(inputs) if repeat_only else inputs
