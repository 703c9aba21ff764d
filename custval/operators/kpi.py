"""Customer KPIs per calendar month: acquisition, retention, churn, conversion.

* acquisition: customers whose first purchase falls in the month, and their
  share of all customers acquired up to the month's end;
* every calendar month from the first to the last has a row, also one without activity;
* retention: customers active in the month who were also active the month
  before, over the previous month's active customers; churn = 1 - retention;
* conversion: users with a target event (a purchase) over users with any
  event in the month.

Activity is reduced to one bitmap of months per customer and era of 62 months in
one aggregate; a month's customers and those retained from the month before are
bits of it, without a window over each customer's months.  The month-level tables
have one row per month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_of(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc("month", c)


def monthly_activity(df: DataFrame, customer: str, date: str) -> DataFrame:
    """Distinct (customer_id, month) pairs with a purchase."""
    return (
        df.filter(F.col(customer).isNotNull() & F.col(date).isNotNull())
        .select(F.col(customer).alias("customer_id"), month_of(date).alias("month"))
        .distinct()
    )


#: Months of an era: bits 1 to ERA_MONTHS of a bitmap; bit 0 is the last month of the era before.
ERA_MONTHS = 62


def activity_bitmaps(df: DataFrame, customer: str, date: str) -> DataFrame:
    """customer_id, era, months: which months of each era a customer bought in, as the bits of a long.

    One aggregate; every task combines its rows to one long per customer and era before the
    exchange.  A purchase in the last month of an era also sets bit 0 of the next.
    """
    day = F.col(date)
    number = F.year(day) * 12 + F.month(day) - 1
    bought = df.filter(F.col(customer).isNotNull() & day.isNotNull()).select(F.col(customer).alias("customer_id"), number.alias("number"))
    era, place = F.floor(F.col("number") / ERA_MONTHS), F.pmod(F.col("number"), F.lit(ERA_MONTHS)) + 1

    def mark(era: Column, place: Column) -> Column:
        return F.struct(era.cast("long").alias("era"), F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")).alias("bit"))

    twice = F.when(place == ERA_MONTHS, F.array(mark(era, place), mark(era + 1, F.lit(0)))).otherwise(F.array(mark(era, place)))
    marks = bought.select("customer_id", F.inline(twice))
    return marks.groupBy("customer_id", "era").agg(F.bit_or("bit").alias("months"))


def active_months(bitmaps: DataFrame) -> DataFrame:
    """customer_id, month, retained: every month a customer was active in, and whether in the month before too (b & b << 1)."""
    places = F.filter(F.sequence(F.lit(1), F.lit(ERA_MONTHS)), lambda i: F.getbit("months", i) == 1)
    rows = bitmaps.select("customer_id", "era", "months", F.explode(places).alias("place"))
    number = F.col("era") * ERA_MONTHS + F.col("place") - 1
    first = F.make_date((number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1))
    return rows.select("customer_id", first.alias("month"), (F.getbit("months", F.col("place") - 1) == 1).alias("retained"))


def _period(month: str = "month") -> Column:
    return F.date_format(F.col(month), "yyyy-MM").alias("period")


def calendar(months: DataFrame) -> DataFrame:
    """Every calendar month from the first to the last ``month`` (none for an empty table)."""
    ends = months.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))


def acquisition(df: DataFrame, customer: str, date: str) -> DataFrame:
    """period, new_customers, customers_to_date, acquisition_rate; one row for every month from the first to the last."""
    purchases = df.filter(F.col(customer).isNotNull() & F.col(date).isNotNull())
    first = purchases.groupBy(customer).agg(month_of(F.min(date)).alias("month"))
    months = calendar(purchases.select(month_of(date).alias("month")))
    # one row per month from here on
    per_month = months.join(first.groupBy("month").agg(F.count("*").alias("n")), "month", "left").select(
        "month", F.coalesce("n", F.lit(0)).alias("new_customers")
    )
    running = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_month.select(
        _period(),
        "new_customers",
        F.sum("new_customers").over(running).alias("customers_to_date"),
    ).withColumn("acquisition_rate", F.col("new_customers") / F.col("customers_to_date"))


def retention(df: DataFrame, customer: str, date: str) -> DataFrame:
    """period, active_customers, retained_customers, retention_rate, churn_rate.

    One row for every calendar month from the first to the last.  Rates compare
    with the previous month: a month without activity after an active one has
    churn 1; the first month, and a month after an inactive one, has no rates.
    """
    counted = active_months(activity_bitmaps(df, customer, date)).groupBy("month").agg(
        F.count("*").alias("active"), F.count_if("retained").alias("retained")
    )
    # one row per month from here on; the months up to the next active one have no customers
    following = F.lead("month").over(Window.orderBy("month"))
    spans = counted.withColumn("until", F.coalesce(F.add_months(following, -1), F.col("month")))
    every = spans.withColumn("of", F.explode(F.sequence("month", "until", F.expr("INTERVAL 1 MONTH"))))
    here = F.col("of") == F.col("month")
    per_month = every.select(
        F.col("of").alias("month"),
        F.when(here, F.col("active")).otherwise(0).alias("active_customers"),
        F.when(here, F.col("retained")).otherwise(0).alias("retained_customers"),
    )
    before = F.lag("active_customers").over(Window.orderBy("month")).cast("double")
    rate = F.try_divide(F.col("retained_customers").cast("double"), F.col("previous"))
    return per_month.withColumn("previous", before).select(
        _period(),
        "active_customers",
        "retained_customers",
        rate.alias("retention_rate"),
        (F.lit(1.0) - rate).alias("churn_rate"),
    )


def conversion(
    events: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    event_type: str = "event_type",
    target: str = "purchase",
) -> DataFrame:
    """period, visitors, converted, conversion_rate."""
    per_user_month = (
        events.filter(F.col(user).isNotNull())
        .groupBy(F.col(user).alias("user_id"), month_of(ts).alias("month"))
        .agg(F.max(F.col(event_type) == F.lit(target)).alias("converted"))
    )
    return per_user_month.groupBy("month").agg(
        F.count("*").alias("visitors"),
        F.count_if("converted").alias("converted"),
    ).select(
        _period(),
        "visitors",
        "converted",
        (F.col("converted") / F.col("visitors")).alias("conversion_rate"),
    )
