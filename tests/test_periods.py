"""Invoice lines stored by year: both formats keep the year, and reading one year opens one folder."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from conftest import SF_SMALL

from custval.__main__ import main
from custval.plans.retail import rfm_retail
from custval.sources.readers import INVOICE_SCHEMA, read_invoices
from custval.sources.sinks import write_invoices, write_table
from custval.sources.tables import invoice_lines


def lines(spark):
    rows = [
        (f"{i}", "85048", 'LAMP, "RED"' if i % 3 else None, float(i), dt.datetime(2009 + i % 3, 1 + i % 12, 1, 7, 45), 6.95, 13000 + i % 7, "UK")
        for i in range(60)
    ]
    return spark.createDataFrame([*rows, ("x", "1", "no date", 1.0, None, 1.0, 1, "UK")], INVOICE_SCHEMA)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_one_year_opens_one_folder(spark, tmp_path, fmt):
    path = f"{tmp_path}/lines"
    write_invoices(lines(spark), path, fmt)
    whole = read_invoices(spark, path, fmt)
    assert whole.columns == [*INVOICE_SCHEMA.names, "year"] and whole.count() == 61
    assert {r.year for r in whole.select("year").distinct().collect()} == {2009, 2010, 2011, None}
    one = read_invoices(spark, path, fmt, years=[2010])
    assert "PartitionFilters: [" in _plan(one) and re.search(r"PartitionFilters: \[[^\]]*year", _plan(one))
    assert {re.search(r"year=(\w+)", f)[1] for f in one.inputFiles()} >= {"2010"}
    folders = {re.search(r"year=(\w+)", r[0])[1] for r in one.selectExpr("input_file_name()").distinct().collect()}
    assert folders == {"2010"}
    got = sorted(tuple(r) for r in one.select(*INVOICE_SCHEMA.names).na.fill("").collect())
    want = sorted(tuple(r) for r in lines(spark).where("year(InvoiceDate) = 2010").na.fill("").collect())
    assert got == want
    later = read_invoices(spark, path, fmt).where("year > 2010")
    assert re.search(r"PartitionFilters: \[[^\]]*year", _plan(later)) and later.count() == 20


def test_years_need_the_layout(spark, tmp_path):
    write_table(lines(spark), f"{tmp_path}/plain", "parquet")
    assert read_invoices(spark, f"{tmp_path}/plain", "parquet").columns == INVOICE_SCHEMA.names
    with pytest.raises(ValueError, match="year="):
        read_invoices(spark, f"{tmp_path}/plain", "parquet", years=[2010])


def test_pipeline_of_one_period(spark, tmp_path):
    """The command of a year equals the pipeline on that year's lines."""
    whole = invoice_lines(spark, SF_SMALL)
    write_invoices(whole, f"{tmp_path}/lines", "csv")
    assert main(["rfm", "--invoices", f"{tmp_path}/lines", "--out", f"{tmp_path}/out", "--year", "1995", "--drop-scores"]) == 0
    got = spark.read.option("header", True).csv(f"{tmp_path}/out/rfm").select("customer_id", "segment")
    want = rfm_retail(whole.where("year(InvoiceDate) = 1995"), keep_scores=False).selectExpr("CAST(customer_id AS STRING) AS customer_id", "segment")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
