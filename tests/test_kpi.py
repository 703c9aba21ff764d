"""KPIs on hand-made purchase histories against brute force."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import pytest

from custval.operators.kpi import acquisition, conversion, retention

PURCHASES = [
    (1, dt.datetime(2021, 1, 5, 10)), (1, dt.datetime(2021, 1, 20)), (1, dt.datetime(2021, 2, 3)),
    (2, dt.datetime(2021, 1, 31, 23, 59)), (2, dt.datetime(2021, 3, 1)),
    (3, dt.datetime(2021, 2, 14)), (3, dt.datetime(2021, 3, 2)), (3, dt.datetime(2021, 4, 9)),
    (4, dt.datetime(2021, 4, 1)),
]


def _month(ts):
    return f"{ts.year:04d}-{ts.month:02d}"


def _frame(spark):
    return spark.createDataFrame(PURCHASES, "cust long, ts timestamp_ntz")


def test_acquisition(spark):
    got = {r["period"]: r for r in acquisition(_frame(spark), "cust", "ts").collect()}
    first = {}
    for c, ts in sorted(PURCHASES, key=lambda r: r[1]):
        first.setdefault(c, _month(ts))
    new = defaultdict(int)
    for m in first.values():
        new[m] += 1
    total = 0
    for m in sorted(new):
        total += new[m]
        assert got[m]["new_customers"] == new[m]
        assert got[m]["customers_to_date"] == total
        assert got[m]["acquisition_rate"] == pytest.approx(new[m] / total)


def test_retention_and_churn(spark):
    got = {r["period"]: r for r in retention(_frame(spark), "cust", "ts").collect()}
    active = defaultdict(set)
    for c, ts in PURCHASES:
        active[_month(ts)].add(c)
    months = sorted(active)
    for m in months:
        y, mo = map(int, m.split("-"))
        prev = f"{y - (mo == 1):04d}-{(mo - 2) % 12 + 1:02d}"
        retained = active[m] & active.get(prev, set())
        assert got[m]["active_customers"] == len(active[m])
        assert got[m]["retained_customers"] == len(retained)
        if prev in active:
            rate = len(retained) / len(active[prev])
            assert got[m]["retention_rate"] == pytest.approx(rate)
            assert got[m]["churn_rate"] == pytest.approx(1 - rate)
        else:
            assert got[m]["retention_rate"] is None


def test_months_without_activity_have_rows(spark):
    rows = [(1, dt.datetime(2020, 12, 5)), (2, dt.datetime(2020, 12, 9)), (1, dt.datetime(2021, 3, 1)), (None, dt.datetime(2021, 5, 1))]
    df = spark.createDataFrame(rows, "cust long, ts timestamp_ntz")
    got = [tuple(r) for r in retention(df, "cust", "ts").orderBy("period").collect()]
    assert got == [
        ("2020-12", 2, 0, None, None),
        ("2021-01", 0, 0, 0.0, 1.0),
        ("2021-02", 0, 0, None, None),
        ("2021-03", 1, 0, None, None),
    ]
    new = [tuple(r) for r in acquisition(df, "cust", "ts").orderBy("period").collect()]
    assert new == [("2020-12", 2, 2, 1.0), ("2021-01", 0, 2, 0.0), ("2021-02", 0, 2, 0.0), ("2021-03", 0, 2, 0.0)]
    empty = spark.createDataFrame([], "cust long, ts timestamp_ntz")
    assert retention(empty, "cust", "ts").count() == acquisition(empty, "cust", "ts").count() == 0


def test_conversion(spark):
    events = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "view"), (1, dt.datetime(2024, 1, 2), "purchase"),
         (2, dt.datetime(2024, 1, 3), "click"), (3, dt.datetime(2024, 2, 1), "purchase"),
         (3, dt.datetime(2024, 2, 2), "purchase")],
        "user_id long, ts timestamp_ntz, event_type string",
    )
    got = {r["period"]: (r["visitors"], r["converted"], r["conversion_rate"]) for r in conversion(events).collect()}
    assert got == {"2024-01": (2, 1, 0.5), "2024-02": (1, 1, 1.0)}
