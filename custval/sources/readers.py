"""Readers for the two input shapes, with declared schemas (no inference pass).

Invoice lines come one file (or one directory) per period, e.g. one per yearly
sheet; reading a list of paths, or a directory with a folder ``year=2010`` for each
period, lets Spark leave out whole periods: the column ``year`` of such a layout is
kept, and filters on it (``years``, or a later ``where``) open only its folders.
Spreadsheet workbooks are not read directly: export each sheet to CSV or Parquet first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


INVOICE_SCHEMA = T.StructType(
    [
        T.StructField("Invoice", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.DoubleType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("Price", T.DoubleType()),
        T.StructField("Customer ID", T.LongType()),
        T.StructField("Country", T.StringType()),
    ]
)

#: The partition column of invoice lines that are stored by period.
PERIOD = "year"

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("master_id", T.StringType()),
        T.StructField("order_channel", T.StringType()),
        T.StructField("last_order_channel", T.StringType()),
        T.StructField("first_order_date", T.StringType()),
        T.StructField("last_order_date", T.StringType()),
        T.StructField("last_order_date_online", T.StringType()),
        T.StructField("last_order_date_offline", T.StringType()),
        T.StructField("order_num_total_ever_online", T.DoubleType()),
        T.StructField("order_num_total_ever_offline", T.DoubleType()),
        T.StructField("customer_value_total_ever_offline", T.DoubleType()),
        T.StructField("customer_value_total_ever_online", T.DoubleType()),
        T.StructField("interested_in_categories_12", T.StringType()),
    ]
)


def _read_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV files with a header, columns taken by name; a value that does not fit its type fails the read.

    Quotes inside quoted fields are doubled.  Empty fields are null.  Whole numbers
    may be written as floats (``13085.0``).  Line breaks inside quoted fields need
    ``multi_line`` (each file is then one task; without it such a row fails the read).
    """
    frames = []
    for path in paths:
        text = spark.read.option("columnPruning", False).csv(
            path, header=True, inferSchema=False, escape='"', multiLine=multi_line, mode="FAILFAST"
        )
        missing = [f.name for f in schema if f.name not in text.columns]
        if missing:
            raise ValueError(f"{path} lacks the columns {missing}")
        columns = []
        for f in schema:
            value = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.LongType):
                number = value.cast("double")
                whole = F.when(number == F.floor(number), number.cast("long"))
                bad = F.raise_error(F.concat(F.lit(f"{f.name}: no whole number: "), value))
                value = F.when(value.isNotNull() & whole.isNull(), bad).otherwise(whole)
            else:
                value = value.cast(f.dataType)  # fails on text that is no number or date (ANSI cast)
            columns.append(value.alias(f.name))
        if PERIOD in text.columns and PERIOD not in schema.names:
            columns.append(F.col(PERIOD).cast("int").alias(PERIOD))
        frames.append(text.select(*columns))
    return reduce(DataFrame.unionByName, frames)


def read_invoices(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "csv",
    multi_line: bool = False,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Invoice lines from CSV or Parquet with :data:`INVOICE_SCHEMA`; every row of the files is kept.

    A folder with one subfolder ``year=...`` per period adds the column ``year``; ``years`` reads these
    periods only (an error for files without the layout).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = _read_csv(spark, paths, INVOICE_SCHEMA, multi_line) if fmt == "csv" else spark.read.schema(INVOICE_SCHEMA).format(fmt).load(paths)
    if years is None:
        return lines
    if PERIOD not in lines.columns:
        raise ValueError(f"{paths} have no folders {PERIOD}=...")
    return lines.where(F.col(PERIOD).isin([int(y) for y in years]))


def read_customer_summary(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The customer summary; date columns stay text until :func:`data_prep` parses them."""
    if fmt == "csv":
        return _read_csv(spark, [path], SUMMARY_SCHEMA)
    return spark.read.schema(SUMMARY_SCHEMA).format(fmt).load(path)


def schema_table(df: DataFrame) -> DataFrame:
    """The columns of a table as rows: position, column_name, type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, type string, nullable boolean")
