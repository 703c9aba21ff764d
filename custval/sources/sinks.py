"""Writers for result tables and id lists.

Results are written by the executors in parallel (one file per partition);
nothing is gathered on the driver.  ``single_file=True`` coalesces to one
partition first - meant for short id lists only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custval.sources.readers import PERIOD


def write_table(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", single_file: bool = False
) -> None:
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_ids(ids: DataFrame, path: str, column: str | None = None, mode: str = "overwrite") -> None:
    """A one-column id list (no positional index column)."""
    col = column or ids.columns[0]
    write_table(ids.select(F.col(col)), path, "csv", mode, single_file=False)


def write_invoices(lines: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", date: str = "InvoiceDate") -> None:
    """Invoice lines by period, a folder ``year=...`` each, as ``read_invoices`` prunes them.

    Lines without a date go to the folder of the null year, and are read back with it.
    """
    by_year = lines.withColumn(PERIOD, F.year(date))
    writer = by_year.write.mode(mode).partitionBy(PERIOD)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
