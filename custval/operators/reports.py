"""Group reports and top/bottom lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATS = {"count": F.count, "mean": F.avg, "sum": F.sum}


def group_report(
    df: DataFrame,
    group: str | Sequence[str],
    measures: Sequence[str],
    stats: Sequence[str] = ("count", "mean", "sum"),
) -> DataFrame:
    """One row per group with ``<measure>_<stat>`` columns in a fixed order.

    Sums and means are taken in double precision over the values as they are, so
    measures of any magnitude keep their digits; round the output where the last
    bits (which depend on the order of the partial sums) should not show.
    """
    keys = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*keys).agg(*[_STATS[s](m).alias(f"{m}_{s}") for m in measures for s in stats])


def top_k(df: DataFrame, col: str, k: int, key: str, ascending: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) ``col``; ties by ``key``.

    NaN sorts as the largest double in Spark, so NaN rows are left out (they
    sort last in the reference).  Plans as TakeOrderedAndProject: each task
    keeps its own k best rows, only k rows per task are merged.
    """
    x = F.col(col)
    rows = df.filter(~F.isnan(x)) if dict(df.dtypes)[col] in ("double", "float") else df
    order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    return rows.orderBy(order, F.col(key)).limit(k)


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """Any ``n`` rows, for a look at a table: no order is implied, and no more partitions are read than needed."""
    return df.limit(n)


def invoice_totals(lines: DataFrame, invoice: str = "Invoice", amount: str = "TotalPrice") -> DataFrame:
    """Total amount per invoice (null invoices dropped)."""
    return (
        lines.filter(F.col(invoice).isNotNull())
        .groupBy(invoice)
        .agg(F.sum(amount).alias("total_price"))
    )


def invoice_bills(
    lines: DataFrame, invoice: str = "Invoice", quantity: str = "Quantity", price: str = "Price"
) -> DataFrame:
    """Every invoice's bill: sum of quantity x price, rounded half-even to cents."""
    return (
        lines.filter(F.col(invoice).isNotNull())
        .groupBy(invoice)
        .agg(F.bround(F.sum(F.col(quantity) * F.col(price)), 2).alias("bill"))
    )


def invoice_bill(
    lines: DataFrame, invoice_no: str, invoice: str = "Invoice", quantity: str = "Quantity", price: str = "Price"
):
    """Total bill (quantity x price, rounded to cents) of one invoice."""
    row = (
        lines.filter(F.col(invoice) == F.lit(invoice_no))
        .agg(F.bround(F.sum(F.col(quantity) * F.col(price)), 2).alias("bill"))
        .collect()[0]
    )
    return row["bill"] if row["bill"] is not None else 0.0



def channel_rollup(
    df: DataFrame,
    channel: str = "order_channel",
    customer: str = "master_id",
    orders: str = "order_num_total",
    value: str = "customer_value_total",
) -> DataFrame:
    return df.groupBy(channel).agg(
        F.count(customer).alias("customers"),
        F.sum(orders).alias("order_num_total"),
        F.sum(value).alias("customer_value_total"),
    )
