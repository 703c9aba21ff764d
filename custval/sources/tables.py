"""Input tables.

The library works on two input shapes:

* **invoice lines** (one row per product line of an invoice): ``Invoice``,
  ``StockCode``, ``Description``, ``Quantity``, ``InvoiceDate``, ``Price``,
  ``Customer ID``, ``Country``;
* **customer summary** (one row per customer of an omnichannel retailer):
  ``master_id``, channels, first/last order dates, order counts and values per
  channel side, and the categories bought in the last 12 months.

Real deployments read them with :mod:`custval.sources.readers`.  The test and
benchmark tables are TPC-H style; :func:`invoice_lines` and
:func:`customer_summary` derive both shapes from them with joins and one
aggregation, so every query's work grows with the given tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custval.functions.dates import ntz_literal

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
)

INVOICE_COLUMNS = ("Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country")

# Order priorities counted as the "online" side of the summary table; the
# remaining priorities are the "offline" side.
ONLINE_PRIORITIES = ("1-URGENT", "2-HIGH")


#: A source that is a layout of :func:`store_bucketed` begins so.
CATALOG = "catalog:"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a source: of a folder of Parquet files, or of a bucketed layout and the folder behind it."""
    if sf_dir.startswith(CATALOG):
        prefix, sf_dir = sf_dir.removeprefix(CATALOG).split("|", 1)
        if name in BUCKETED:
            return spark.table(f"{prefix}_{name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Tables of the bucketed layout and their key.
BUCKETED = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def store_bucketed(spark: SparkSession, sf_dir: str, prefix: str, path: str, buckets: int = 200) -> str:
    """Write lineitem and orders once as catalog tables bucketed and sorted by the order key; returns the source to read.

    Their join, which every query on invoice lines makes several times, then needs neither exchange.
    What describes a line or an order (part name, country) is stored with it, as those joins would
    deal the rows anew.  ``path`` is a folder that all executors share; a bucket should fit a task
    (``buckets`` = bytes of lineitem / 128 MB, about).
    """
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = read_table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
    made = {"lineitem": named, "orders": with_country(spark, sf_dir, read_table(spark, sf_dir, "orders")).drop("c_custkey")}
    for name, key in BUCKETED.items():
        rows = made[name].repartition(buckets, key)  # one file a bucket
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{path.rstrip('/')}/{name}").saveAsTable(f"{prefix}_{name}")
    return f"{CATALOG}{prefix}|{sf_dir}"


def with_country(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Orders with c_custkey and n_name, the customer's country."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    country = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select("c_custkey", "n_name")
    return orders.join(country, orders.o_custkey == country.c_custkey, "left")


def invoice_lines(spark: SparkSession, sf_dir: str, columns: Sequence[str] = INVOICE_COLUMNS) -> DataFrame:
    """Invoice lines over lineitem, orders, part, customer and nation.

    With ``columns``, those only: tables that just describe a line (part, customer, nation) are
    joined when a column needs them.  The join with orders, which decides whether a line counts, stays.

    ``Invoice`` is the order key as text, prefixed with "C" for returned lines
    (the cancellation marker).  It is built from ``l_orderkey`` so that the
    cancellation filter only references lineitem columns and Catalyst pushes it
    below the joins.
    """
    li, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    # a bucketed layout stores what describes a line or an order with it
    stored = {"n_name": "n_name" in orders.columns, "p_name": "p_name" in li.columns}
    li = li.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", *["p_name"] * stored["p_name"])
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate", *["n_name"] * stored["n_name"])
    # Dimension side first (orders -> customer -> nation): the fact table is
    # joined once, on the order key.  Join strategies are left to Catalyst/AQE,
    # which broadcast a side only when its measured size is under the threshold.
    if "Country" in columns and not stored["n_name"]:
        orders = with_country(spark, sf_dir, orders)
    lines = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    if "Description" in columns and not stored["p_name"]:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
        lines = lines.join(part, li.l_partkey == part.p_partkey, "left")
    key_text = F.col("l_orderkey").cast("string")
    made = {
        "Invoice": lambda: F.when(F.col("l_returnflag") == "R", F.concat(F.lit("C"), key_text)).otherwise(key_text),
        "StockCode": lambda: F.col("l_partkey").cast("string"),
        "Description": lambda: F.col("p_name"),
        "Quantity": lambda: F.col("l_quantity"),
        "InvoiceDate": lambda: F.col("o_orderdate"),
        "Price": lambda: F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
        "Customer ID": lambda: F.col("o_custkey"),
        "Country": lambda: F.col("n_name"),
    }
    return lines.select(*[made[c]().alias(c) for c in columns])


def default_analysis_date(df: DataFrame, date_col: str, days_after: int = 2) -> dt.datetime:
    """Latest date in ``date_col`` plus ``days_after`` days, at midnight.

    The reference picks its analysis date by hand as "two days after the
    latest invoice"; this is that rule.  One scalar reaches the driver.
    """
    return date_after(df.agg(F.max(date_col).alias("d")).collect()[0]["d"], date_col, days_after)


def date_after(latest: dt.date | None, date_col: str, days_after: int = 2) -> dt.datetime:
    """Midnight ``days_after`` days after the latest date of a column."""
    if latest is None:
        raise ValueError(f"{date_col} has no values")
    day = dt.datetime(latest.year, latest.month, latest.day)
    return day + dt.timedelta(days=days_after)


def _channel_sums(online: Column) -> list[Column]:
    date = F.col("o_orderdate")
    price = F.col("o_totalprice")
    return [
        F.max(F.when(online, date)).alias("last_order_date_online"),
        F.max(F.when(~online, date)).alias("last_order_date_offline"),
        F.count_if(online).cast("double").alias("order_num_total_ever_online"),
        F.count_if(~online).cast("double").alias("order_num_total_ever_offline"),
        F.round(F.coalesce(F.sum(F.when(~online, price)), F.lit(0.0)), 2).alias(
            "customer_value_total_ever_offline"
        ),
        F.round(F.coalesce(F.sum(F.when(online, price)), F.lit(0.0)), 2).alias(
            "customer_value_total_ever_online"
        ),
    ]


def customer_summary(
    spark: SparkSession, sf_dir: str, analysis_date: dt.datetime | None = None
) -> DataFrame:
    """One row per customer with orders (the omnichannel summary shape).

    ``order_channel`` is the customer's market segment, ``last_order_channel``
    the priority of the latest order (by date, then order key).  Online orders
    are those with a priority in :data:`ONLINE_PRIORITIES`.
    Values are rounded to cents.  ``interested_in_categories_12`` lists, as
    text "[A, B]", the sorted distinct part types bought in the 12 months
    before ``analysis_date`` (default: two days after the latest order); null
    when there are none.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"
    )
    if analysis_date is None:
        analysis_date = default_analysis_date(orders, "o_orderdate")
    online = F.col("o_orderpriority").isin(*ONLINE_PRIORITIES)

    per_customer = orders.groupBy("o_custkey").agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias(
            "last_order_channel"
        ),
        F.min("o_orderdate").alias("first_order_date"),
        F.max("o_orderdate").alias("last_order_date"),
        *_channel_sums(online),
    )

    since = ntz_literal(analysis_date) - F.expr("INTERVAL 12 MONTHS")
    recent = orders.filter(F.col("o_orderdate") >= since).select("o_orderkey", "o_custkey")
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    # Distinct (customer, type) pairs first: the per-customer list is bounded
    # by the number of part types, however many lines a customer has.
    types = (
        lines.join(recent, lines.l_orderkey == recent.o_orderkey)
        .join(part, lines.l_partkey == part.p_partkey)
        .select("o_custkey", "p_type")
        .distinct()
        .groupBy("o_custkey")
        .agg(F.array_sort(F.collect_list("p_type")).alias("types"))
        .select(
            "o_custkey",
            F.concat(F.lit("["), F.array_join("types", ", "), F.lit("]")).alias(
                "interested_in_categories_12"
            ),
        )
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        per_customer.join(customer, per_customer.o_custkey == customer.c_custkey, "left")
        .join(types, "o_custkey", "left")
        .select(
            F.col("o_custkey").cast("string").alias("master_id"),
            F.col("c_mktsegment").alias("order_channel"),
            "last_order_channel",
            "first_order_date",
            "last_order_date",
            "last_order_date_online",
            "last_order_date_offline",
            "order_num_total_ever_online",
            "order_num_total_ever_offline",
            "customer_value_total_ever_offline",
            "customer_value_total_ever_online",
            "interested_in_categories_12",
        )
    )
