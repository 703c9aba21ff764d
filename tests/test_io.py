"""Readers, sinks and the small helpers around them."""

from __future__ import annotations

import datetime as dt
import pytest
from pyspark.sql import functions as F

from custval.operators.reports import invoice_bill
from custval.plans.omni import data_prep, targets_by_ids
from custval import session
from custval.sources.readers import read_customer_summary, read_invoices, schema_table
from custval.sources.sinks import write_ids, write_table


def _lines(spark):
    rows = [
        ("489434", "85048", "LIGHT", 12.0, dt.datetime(2009, 12, 1, 7, 45), 6.95, 13085, "UK"),
        ("489434", "79323", "HEART", 12.0, dt.datetime(2009, 12, 1, 7, 45), 6.75, 13085, "UK"),
        ("C489435", "22350", "CAT", -12.0, dt.datetime(2009, 12, 1, 7, 46), 2.55, 13085, "UK"),
    ]
    schema = (
        "Invoice string, StockCode string, Description string, Quantity double, "
        "InvoiceDate timestamp_ntz, Price double, `Customer ID` long, Country string"
    )
    return spark.createDataFrame(rows, schema)


def test_invoice_bill(spark):
    assert invoice_bill(_lines(spark), "489434") == round(12 * 6.95 + 12 * 6.75, 2)


def test_invoice_roundtrip_csv_and_parquet(spark, tmp_path):
    out = str(tmp_path)
    lines = _lines(spark)
    write_table(lines, f"{out}/csv", "csv")
    write_table(lines, f"{out}/pq", "parquet")
    for fmt, path in (("csv", f"{out}/csv"), ("parquet", f"{out}/pq")):
        back = read_invoices(spark, path, fmt=fmt)
        assert back.schema == read_invoices(spark, f"{out}/pq", fmt="parquet").schema
        assert sorted(back.collect()) == sorted(lines.collect())


def test_summary_reader_and_date_parsing(spark, tmp_path):
    out = str(tmp_path)
    path = f"{out}/summary.csv"
    with open(path, "w") as fh:
        fh.write(
            "master_id,order_channel,last_order_channel,first_order_date,last_order_date,"
            "last_order_date_online,last_order_date_offline,order_num_total_ever_online,"
            "order_num_total_ever_offline,customer_value_total_ever_offline,"
            "customer_value_total_ever_online,interested_in_categories_12\n"
            'a1,Android App,Offline,2020-10-30,2021-02-26,2021-02-21,2021-02-26,4.0,1.0,139.99,799.38,"[KADIN]"\n'
        )
    prepared = data_prep(read_customer_summary(spark, path))
    row = prepared.first()
    assert row["last_order_date"] == dt.datetime(2021, 2, 26)
    assert row["order_num_total"] == 5.0
    assert row["customer_value_total"] == 139.99 + 799.38


def test_id_list_has_one_column(spark, tmp_path):
    out = str(tmp_path)
    ids = spark.range(5).select(F.col("id").alias("new_customer_id"))
    write_ids(ids, f"{out}/ids")
    back = spark.read.option("header", True).csv(f"{out}/ids")
    assert back.columns == ["new_customer_id"] and back.count() == 5


def test_targets_by_ids_semi_join(spark):
    summary = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "master_id string, v int")
    ids = spark.createDataFrame([("a",), ("c",), ("z",)], "customer_id string")
    got = sorted(r["master_id"] for r in targets_by_ids(summary, ids).collect())
    assert got == ["a", "c"]


def test_rfm_written_as_csv(spark, tmp_path):
    from conftest import SF_SMALL

    from custval.plans.retail import rfm_retail
    from custval.sources.tables import invoice_lines

    out = str(tmp_path) + "/rfm"
    rfm = rfm_retail(invoice_lines(spark, SF_SMALL), keep_scores=False, output_path=out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["customer_id", "recency", "frequency", "monetary", "segment"]
    assert back.count() == rfm.count() == 150


def test_clear_materialized(spark):
    import os

    from custval.session import clear_materialized, materialize, materialized_root

    df = materialize(spark.range(10), "probe")
    assert df.count() == 10
    root = materialized_root(spark).replace("file:", "")
    assert os.path.isdir(root)
    assert clear_materialized(spark)
    assert not os.path.exists(root)
    assert materialize(spark.range(3), "probe").count() == 3  # the folder is recreated on demand


HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


def _write(tmp_path, text, name="a.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv_keeps_every_row(spark, tmp_path):
    """Float ids, doubled quotes with commas, a line break in a field, blanks, unicode."""
    path = _write(
        tmp_path,
        HEADER
        + '489434,85048,"15CM ""XMAS"" GLASS BALL, 20 LIGHTS",12,2009-12-01 07:45:00,6.95,13085.0,United Kingdom\n'
        + '489435,22350,"two\nlines",24,2009-12-01 07:46:00,2.55,13085,France\n'
        + "489436,,,-1,2009-12-01 07:50:00,0,,España\n",
    )
    with pytest.raises(Exception, match="(?i)malformed"):  # a line break needs multi_line; no row is lost silently
        read_invoices(spark, path).count()
    rows = sorted(read_invoices(spark, path, multi_line=True).collect())
    assert [r["Customer ID"] for r in rows] == [13085, 13085, None]
    assert rows[0].Description == '15CM "XMAS" GLASS BALL, 20 LIGHTS' and rows[1].Description == "two\nlines"
    assert rows[2].StockCode is None and rows[2].Country == "España" and rows[2].Quantity == -1.0
    assert rows[0].InvoiceDate == dt.datetime(2009, 12, 1, 7, 45)


def test_csv_columns_by_name_over_several_files(spark, tmp_path):
    one = _write(tmp_path, HEADER + "1,a,x,1,2010-01-01 00:00:00,2.5,7,UK\n", "one.csv")
    two = _write(
        tmp_path,
        "Country,Customer ID,Price,InvoiceDate,Quantity,Description,StockCode,Invoice,Extra\nFR,8.0,3.5,2010-01-02 00:00:00,4,y,b,2,z\n",
        "two.csv",
    )
    got = {r.Invoice: (r.StockCode, r.Quantity, r.Price, r["Customer ID"], r.Country) for r in read_invoices(spark, [one, two]).collect()}
    assert got == {"1": ("a", 1.0, 2.5, 7, "UK"), "2": ("b", 4.0, 3.5, 8, "FR")}


@pytest.mark.parametrize(
    "line", ["1,a,x,1,not-a-date,2.5,7,UK", "1,a,x,one,2010-01-01,2.5,7,UK", "1,a,x,1,2010-01-01,2.5,7.5,UK", "1,a,x,1,2010-01-01,2.5,id,UK"]
)
def test_csv_bad_values_fail(spark, tmp_path, line):
    with pytest.raises(Exception, match="(?i)cast|whole number|malformed|invalid"):
        read_invoices(spark, _write(tmp_path, HEADER + line + "\n")).collect()


def test_csv_missing_column_fails(spark, tmp_path):
    with pytest.raises(ValueError, match="Country"):
        read_invoices(spark, _write(tmp_path, HEADER.replace(",Country", "") + "1,a,x,1,2010-01-01,2.5,7\n"))


def test_schema_table(spark):
    rows = schema_table(_lines(spark)).collect()
    assert [(r.column_name, r.type) for r in rows][3:5] == [("Quantity", "double"), ("InvoiceDate", "timestamp_ntz")]


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_scratch_removes_its_tables_only(spark):
    kept = session.materialize(spark.range(3), "kept")
    with pytest.raises(KeyError), session.Scratch(spark) as scratch:
        session.materialize(spark.range(5), "gone")
        raise KeyError
    assert len(scratch.paths) == 1 and not session.delete(spark, scratch.paths[0])
    assert kept.count() == 3
