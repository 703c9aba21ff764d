"""Command line: run a pipeline on input files and write the results as CSV.

    python -m custval rfm          --invoices PATH [PATH ...] --out DIR [--format parquet]
    python -m custval clv          --invoices PATH ... --out DIR [--profit 0.10]
    python -m custval clv-predict  --invoices PATH ... --out DIR [--months 3] [model options]
    python -m custval omni-rfm     --summary PATH --out DIR     (RFM table + both campaign lists)
    python -m custval omni-clv     --summary PATH --out DIR [--months 6] [--split-top] [model options]

Model options: --analysis-date, --horizon NAME=WEEKS, --bg-penalizer, --gg-penalizer, --discount-rate, --all-customers.

Each command writes one or more CSV folders under ``--out`` (one file per
partition, written by the executors) and then removes its intermediate tables.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys


def _date(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m custval", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, source: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        if source == "invoices":
            s.add_argument("--invoices", nargs="+", required=True, help="invoice-line files or folders")
            s.add_argument("--year", type=int, action="append", help="read this period only (folders year=...; repeatable)")
        else:
            s.add_argument("--summary", required=True, help="customer-summary file or folder")
        s.add_argument("--format", default="csv", choices=["csv", "parquet"])
        s.add_argument("--out", required=True, help="output folder")
        s.add_argument("--master", default=None, help="Spark master (default: from the environment)")
        return s

    s = add("rfm", "invoices")
    s.add_argument("--analysis-date", type=_date)
    s.add_argument("--drop-scores", action="store_true")
    s = add("clv", "invoices")
    s.add_argument("--profit", type=float, default=0.10)
    s = add("clv-predict", "invoices")
    s.add_argument("--months", type=int, default=3)
    _model_flags(s)
    s = add("omni-rfm", "summary")
    s.add_argument("--analysis-date", type=_date)
    s = add("omni-clv", "summary")
    s.add_argument("--months", type=int, default=6)
    s.add_argument("--split-top", action="store_true")
    _model_flags(s)
    return p


def _model_flags(s: argparse.ArgumentParser) -> None:
    s.add_argument("--analysis-date", type=_date, help="default: two days after the latest purchase")
    s.add_argument("--horizon", action="append", type=_horizon, metavar="NAME=WEEKS", help="expected-purchase column (repeatable)")
    s.add_argument("--bg-penalizer", type=float, default=0.001)
    s.add_argument("--gg-penalizer", type=float, default=0.01)
    s.add_argument("--discount-rate", type=float, default=0.01, help="per month")
    s.add_argument("--all-customers", action="store_true", help="script form: keep zero-value and one-time customers")


def _horizon(text: str) -> tuple[str, float]:
    name, weeks = text.split("=")
    return name, float(weeks)


def _model_options(args: argparse.Namespace) -> dict:
    return {
        "analysis_date": args.analysis_date,
        "horizons": dict(args.horizon) if args.horizon else None,
        "bg_penalizer": args.bg_penalizer,
        "gg_penalizer": args.gg_penalizer,
        "discount_rate": args.discount_rate,
    }


def _tell(remarks: list[str]) -> None:
    for remark in remarks:
        print(f"note: {remark}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from custval.plans import omni, predict, retail
    from custval.session import Scratch, get_spark
    from custval.sources.readers import read_customer_summary, read_invoices
    from custval.sources.sinks import write_ids, write_table

    spark = get_spark(args.master)
    out = args.out.rstrip("/")
    with Scratch(spark):  # intermediate tables go when the results are written, or on failure
        if args.command in ("rfm", "clv", "clv-predict"):
            lines = read_invoices(spark, args.invoices, fmt=args.format, years=args.year)
            if args.command == "rfm":
                rfm = retail.rfm_retail(lines, args.analysis_date, keep_scores=not args.drop_scores)
                write_table(rfm, f"{out}/rfm")
                write_ids(
                    rfm.filter("segment = 'new_customers'").selectExpr("CAST(customer_id AS BIGINT) AS new_customer_id"),
                    f"{out}/new_customers",
                )
            elif args.command == "clv":
                write_table(retail.clv_formula_retail(lines, args.profit), f"{out}/clv_segment")
            else:
                pred = predict.clv_predict_retail(lines, args.months, repeat_only=not args.all_customers, **_model_options(args))
                write_table(pred.table, f"{out}/clv_prediction")
                _tell(pred.remarks())
        else:
            summary = read_customer_summary(spark, args.summary, fmt=args.format)
            if args.command == "omni-rfm":
                rfm = omni.rfm_omni(summary, args.analysis_date)
                write_table(rfm.drop(omni.CATEGORY_COL), f"{out}/rfm")
                write_ids(omni.brand_campaign(rfm), f"{out}/new_brand_target_ids")
                write_ids(omni.discount_campaign(rfm), f"{out}/discount_target_customer_ids")
            else:
                pred = predict.clv_predict_omni(
                    summary, args.months, split_top=args.split_top, repeat_only=not args.all_customers, **_model_options(args)
                )
                write_table(pred.table, f"{out}/clv")
                _tell(pred.remarks())
    return 0


if __name__ == "__main__":
    sys.exit(main())
