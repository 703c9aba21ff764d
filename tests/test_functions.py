"""Scalar functions, filters, caps and segment maps on hand-made rows."""

from __future__ import annotations

import datetime as dt
import itertools
import re

from pyspark.sql import functions as F

from custval.functions.dates import days_between, to_timestamp_columns
from custval.functions.segments import RF_SEGMENT_MAP, segment_lookup, segment_of
from custval.operators.clv import clv_formula
from custval.operators.filters import drop_cancelled, drop_nulls, keep_value_or_no_orders
from custval.operators.outliers import cap_both_rounded, outlier_thresholds


def test_floor_days(spark):
    df = spark.createDataFrame(
        [
            (dt.datetime(2010, 12, 9, 20, 1), dt.datetime(2010, 12, 11)),
            (dt.datetime(2010, 12, 12, 1, 0), dt.datetime(2010, 12, 11)),
            (dt.datetime(2010, 12, 9), dt.datetime(2010, 12, 11)),
        ],
        "a timestamp_ntz, b timestamp_ntz",
    )
    got = [r[0] for r in df.select(days_between("b", "a")).collect()]
    assert got == [1, -2, 2]


def test_date_columns_parsed_by_name(spark):
    df = spark.createDataFrame([("2021-05-30", "x")], "last_order_date string, channel string")
    out = to_timestamp_columns(df)
    assert dict(out.dtypes) == {"last_order_date": "timestamp_ntz", "channel": "string"}


def test_cancelled_invoice_filter(spark):
    df = spark.createDataFrame([("C489435",), ("489434",), ("48C9",), (None,)], "Invoice string")
    kept = [r[0] for r in drop_cancelled(df).collect()]
    assert sorted(kept, key=str) == sorted(["489434", None], key=str)


def test_drop_nulls_drops_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (2.0, None)], "x double, s string")
    assert drop_nulls(df).count() == 1


def test_zero_value_filter(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0), (0.0, 2.0), (5.0, 0.0), (5.0, 2.0)],
        "customer_value_total double, order_num_total double",
    )
    kept = {(r[0], r[1]) for r in keep_value_or_no_orders(df).collect()}
    assert kept == {(0.0, 0.0), (5.0, 0.0), (5.0, 2.0)}


def test_half_even_caps(spark):
    # limits computed so that low = 2.5 and up = 3.5 exactly are rounded half-even
    assert round(2.5, 0) == 2 and round(3.5, 0) == 4
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3.0] * 98 + [0.0, 100.0])], "k long, x double")
    limits = outlier_thresholds(df, ["x"], key="k")
    capped, _ = cap_both_rounded(df, ["x"], key="k")
    low, up = limits["x"]
    values = sorted(r["x"] for r in capped.collect())
    assert values[0] == (float(round(low, 0)) if 0.0 < low else 0.0)
    assert values[-1] == (float(round(up, 0)) if 100.0 > up else 100.0)


def test_segment_map_covers_pairs_once():
    for r, f in itertools.product(range(1, 6), repeat=2):
        score = f"{r}{f}"
        matches = [label for pat, label in RF_SEGMENT_MAP.items() if re.fullmatch(pat, score)]
        assert len(matches) == 1
        assert segment_lookup()[score] == matches[0]


def test_segment_column(spark):
    df = spark.createDataFrame([("11",), ("55",), ("51",), ("33",), (None,)], "s string")
    got = [r[0] for r in df.select(segment_of("s")).collect()]
    assert got == ["hibernating", "champions", "new_customers", "need_attention", None]


def test_clv_without_churn_is_null(spark):
    base = spark.createDataFrame(
        [(1, 2, 3.0, 10.0), (2, 3, 4.0, 20.0)],
        "customer_id long, total_transaction long, total_unit double, total_price double",
    )
    rows = clv_formula(base).collect()
    assert all(r["clv"] is None for r in rows)
    from custval.operators.quantiles import qcut

    seg = qcut(clv_formula(base), "clv", 4, ["D", "C", "B", "A"], "segment", "customer_id")
    assert [r["segment"] for r in seg.collect()] == [None, None]


def test_equal_clv_one_row_each(spark):
    from custval.plans.predict import split_top_segment

    df = spark.createDataFrame(
        [(i, float(v), "A") for i, v in enumerate([5, 5, 7, 9])],
        "customer_id long, clv double, clv_segment string",
    )
    out = split_top_segment(df)
    assert out.count() == 4
    assert [r["clv_segment"] for r in out.orderBy("customer_id").collect()] == ["A2", "A2", "A1", "A1"]


def test_sig_round_matches_python(spark):
    from custval.functions.numeric import sig_round

    vals = [123456.789012345, 0.000123456789123, -98765.4321987, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(sig_round(F.col("x"), 6)).collect()]
    assert got == [123457.0, 0.000123457, -98765.4, 0.0]


def test_floor_days_ignores_session_time_zone(spark):
    """Whole days are wall-clock days, also across a daylight-saving change."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.sql(
            "SELECT TIMESTAMP_NTZ'2001-03-31 12:00:00' AS a, TIMESTAMP_NTZ'2001-04-01 12:00:00' AS b "
            "UNION ALL SELECT TIMESTAMP_NTZ'2001-04-01 01:30:00', TIMESTAMP_NTZ'2001-04-02 01:00:00' "
            "UNION ALL SELECT TIMESTAMP_NTZ'2001-10-27 12:00:00', TIMESTAMP_NTZ'2001-10-28 12:00:00'"
        )
        assert [r[0] for r in df.select(days_between("b", "a")).collect()] == [1, 0, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_rfm_scores_with_four_levels(spark):
    import numpy as np
    import pandas as pd

    from custval.operators.rfm import rfm_scores

    rng = np.random.default_rng(4)
    n = 300
    pdf = pd.DataFrame(
        {
            "customer_id": np.arange(n),
            "recency": rng.integers(0, 400, n),
            "frequency": rng.integers(1, 12, n),
            "monetary": np.round(rng.gamma(2, 300, n), 2),
        }
    )
    got = rfm_scores(spark.createDataFrame(pdf), q=4).toPandas().sort_values("customer_id")
    r = pd.qcut(pdf["recency"], 4, labels=[4, 3, 2, 1]).astype(int)
    f = pd.qcut(pdf["frequency"].rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    m = pd.qcut(pdf["monetary"], 4, labels=[1, 2, 3, 4]).astype(int)
    assert got["recency_score"].tolist() == r.tolist()
    assert got["frequency_score"].tolist() == f.tolist()
    assert got["monetary_score"].tolist() == m.tolist()
    assert got["RF_SCORE"].tolist() == (r.astype(str) + f.astype(str)).tolist()


def test_approximate_distinct_counts(spark):
    from custval.operators.profile import distinct_counts

    df = spark.range(5000).selectExpr("id % 97 AS a", "id AS b")
    exact = {r[0]: r[1] for r in distinct_counts(df, ["a", "b"]).collect()}
    approx = {r[0]: r[1] for r in distinct_counts(df, ["a", "b"], approx=True).collect()}
    assert exact == {"a": 97, "b": 5000}
    # HyperLogLog with the default 5% relative standard deviation: allow three of them
    assert abs(approx["a"] - 97) <= 0.15 * 97 and abs(approx["b"] - 5000) <= 0.15 * 5000
