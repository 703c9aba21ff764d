"""Row filters of the invoice-line and customer-summary pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_cancelled(invoice: str = "Invoice") -> Column:
    """True unless the invoice text contains "C" (anywhere, case-sensitive).

    A null invoice is kept, as the reference's ``na=False`` keeps it.
    """
    return ~F.coalesce(F.col(invoice).cast("string").contains("C"), F.lit(False))


def drop_cancelled(df: DataFrame, invoice: str = "Invoice") -> DataFrame:
    return df.filter(not_cancelled(invoice))


def drop_nulls(df: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) in *any* column of the table."""
    return df.na.drop(how="any")


def positive(df: DataFrame, *cols: str) -> DataFrame:
    cond = None
    for c in cols:
        term = F.col(c) > 0
        cond = term if cond is None else cond & term
    return df if cond is None else df.filter(cond)


def repeat_customers(df: DataFrame, frequency: str = "frequency") -> DataFrame:
    """Customers with more than one transaction."""
    return df.filter(F.col(frequency) > 1)


def keep_value_or_no_orders(
    df: DataFrame, value: str = "customer_value_total", orders: str = "order_num_total"
) -> DataFrame:
    """Keep rows with a non-zero value, or with zero orders.

    This is what ``~(value == 0) | (orders == 0)`` means: the negation binds
    before the ``or``.
    """
    return df.filter((F.col(value) != 0) | (F.col(orders) == 0))


def in_segments(df: DataFrame, segments: Sequence[str], segment: str = "segment") -> DataFrame:
    return df.filter(F.col(segment).isin(*segments))


def mentions_any(text: str, words: Sequence[str]) -> Column:
    """Substring test of the whole text against any word; null text -> False."""
    cond = None
    for w in words:
        term = F.coalesce(F.col(text).contains(w), F.lit(False))
        cond = term if cond is None else cond | term
    return cond if cond is not None else F.lit(False)
