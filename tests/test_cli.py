"""The command line runs the pipelines from files and writes CSV results."""

from __future__ import annotations

from conftest import SF_SMALL

from custval.__main__ import main
from custval.sources.sinks import write_table
from custval.sources.tables import customer_summary, invoice_lines


def _csv(spark, path):
    return spark.read.option("header", True).csv(path)


def test_rfm_command(spark, tmp_path):
    work = str(tmp_path)
    write_table(invoice_lines(spark, SF_SMALL), f"{work}/invoices")
    assert main(["rfm", "--invoices", f"{work}/invoices", "--out", f"{work}/out", "--drop-scores"]) == 0
    rfm = _csv(spark, f"{work}/out/rfm")
    assert rfm.columns == ["customer_id", "recency", "frequency", "monetary", "segment"]
    assert rfm.count() == 150
    new = _csv(spark, f"{work}/out/new_customers")
    assert new.columns == ["new_customer_id"]
    assert new.count() == rfm.filter("segment = 'new_customers'").count()


def test_omni_rfm_command(spark, tmp_path):
    work = str(tmp_path)
    write_table(customer_summary(spark, SF_SMALL), f"{work}/summary")
    assert main(["omni-rfm", "--summary", f"{work}/summary", "--out", f"{work}/out"]) == 0
    assert _csv(spark, f"{work}/out/rfm").count() == 150
    for name in ("new_brand_target_ids", "discount_target_customer_ids"):
        assert _csv(spark, f"{work}/out/{name}").columns == ["master_id"]


def test_clv_predict_command_options(spark, tmp_path):
    work = str(tmp_path)
    write_table(invoice_lines(spark, SF_SMALL), f"{work}/invoices")
    args = ["clv-predict", "--invoices", f"{work}/invoices", "--out", f"{work}/out", "--months", "2", "--analysis-date", "2002-01-01"]
    assert main([*args, "--horizon", "in_2_weeks=2", "--discount-rate", "0.02", "--gg-penalizer", "0.02"]) == 0
    out = _csv(spark, f"{work}/out/clv_prediction")
    assert "in_2_weeks" in out.columns and out.count() > 0
