"""Formula-based customer lifetime value.

    average_order_value = total_price / total_transaction
    purchase_frequency  = total_transaction / number of customers
    repeat_rate         = share of customers with more than one transaction
    churn_rate          = 1 - repeat_rate
    profit_margin       = total_price * profit
    customer_value      = average_order_value * purchase_frequency
    clv                 = customer_value / churn_rate * profit_margin

The two global numbers (customer count, churn rate) come from one aggregate
over the per-customer table and enter the per-row expressions as literals -
no join, no second pass over the lines.  A churn rate of 0 gives a null CLV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custval.functions.numeric import safe_ratio


def clv_base(
    lines: DataFrame,
    customer: str = "Customer ID",
    invoice: str = "Invoice",
    quantity: str = "Quantity",
    amount: str = "TotalPrice",
    money_decimals: int | None = 2,
) -> DataFrame:
    """Per customer: distinct invoices, units, and total spend."""
    total = F.sum(amount)
    if money_decimals is not None:
        total = F.round(total, money_decimals)
    return (
        lines.filter(F.col(customer).isNotNull())
        .groupBy(F.col(customer).alias("customer_id"))
        .agg(
            F.count_distinct(invoice).alias("total_transaction"),
            F.sum(quantity).cast("double").alias("total_unit"),
            total.alias("total_price"),
        )
    )


def clv_rates(base: DataFrame) -> DataFrame:
    """One row: customer count, repeat rate and churn rate."""
    n = F.count("*")
    repeat = F.count_if(F.col("total_transaction") > 1) / n
    return base.agg(
        n.alias("n_customers"),
        repeat.alias("repeat_rate"),
        (F.lit(1.0) - repeat).alias("churn_rate"),
    )


def clv_formula(base: DataFrame, profit: float = 0.10) -> DataFrame:
    """Add the CLV columns to a :func:`clv_base` table."""
    rates = clv_rates(base).collect()[0]
    n = rates["n_customers"]
    churn = rates["churn_rate"] if n else None
    aov = safe_ratio("total_price", "total_transaction")
    freq = F.col("total_transaction") / F.lit(float(n or 1))
    return (
        base.withColumn("average_order_value", aov)
        .withColumn("purchase_frequency", freq)
        .withColumn("profit_margin", F.col("total_price") * F.lit(profit))
        .withColumn("customer_value", F.col("average_order_value") * F.col("purchase_frequency"))
        .withColumn(
            "clv",
            F.try_divide(F.col("customer_value"), F.lit(churn).cast("double"))
            * F.col("profit_margin"),
        )
    )
