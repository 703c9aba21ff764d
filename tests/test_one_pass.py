"""Work that is done in few reads: quantiles of several columns, observed counts, month bitmaps, spread pairs."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

import custval.operators.order_stats as order_stats
from custval.operators.kpi import ERA_MONTHS, activity_bitmaps, active_months, retention
from custval.operators.profile import describe
from custval.operators.quantiles import quantiles_many
from custval.plans.catalog import CDNOW_BGNBD, CDNOW_GAMMA_GAMMA
from custval.plans.predict import Prediction, score_customers, scoring_tasks
from custval.plans.retail import rfm_retail
from custval.session import materialize_observed
from custval.sources.tables import invoice_lines


def _columns(rng, n):
    return {
        "a": np.round(rng.normal(500, 120, n), 2),
        "b": rng.integers(0, 3, n).astype(float),  # three values hold all rows
        "c": np.where(rng.random(n) < 0.6, 7.0, rng.exponential(10, n)),  # one value holds most
        "d": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)),
        "e": rng.integers(-(2**40), 2**40, n),
        "f": np.full(n, 3.0),
        "g": np.full(n, np.nan),
    }


def _counted(spark, frame, parts=4):
    """A table whose reads are counted, in rows."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(frame).repartition(parts).mapInArrow(count, spark.createDataFrame(frame).schema), read


@pytest.mark.parametrize(("accuracy", "per"), [(8, 50), (8192, 1_000_000)])
def test_quantiles_of_many_columns_in_three_reads(spark, monkeypatch, accuracy, per):
    monkeypatch.setattr(order_stats, "SKETCH_K", accuracy)
    rng = np.random.default_rng(5)
    n = 3000
    frame = pd.DataFrame({"k": np.arange(n), **_columns(rng, n)})
    df, read = _counted(spark, frame)
    probs = [0.0, 0.01, 0.25, 0.3337, 0.5, 0.75, 0.99, 1.0]
    names = list("abcdefg")
    got = quantiles_many(df, [(c, probs) for c in names], "k", rows_per_partition=per)
    for c, values in zip(names, got, strict=True):
        want = frame[c].quantile(probs).tolist()
        assert values == want or (np.isnan(values).all() and np.isnan(want).all()), c
    if accuracy > 8:  # a good sketch never sends a column to be ordered by itself
        assert read.value <= 3 * n


def test_numeric_summary_reads(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"k": np.arange(2000), **{f"x{i}": rng.normal(i, 1, 2000) for i in range(6)}})
    df, read = _counted(spark, frame)
    out = describe(df, [f"x{i}" for i in range(6)], key="k").toPandas().set_index("column_name")
    assert read.value <= 3 * 2000  # the moments are observed in the first read
    for c in out.index:
        want = frame[c].describe()
        np.testing.assert_allclose(out.loc[c].astype(float), want[["count", "mean", "std", "min", "25%", "50%", "75%", "max"]], rtol=1e-12)


def test_sketch_that_misses_falls_back(spark, monkeypatch):
    """Brackets beside the position are noticed by the exact counts."""
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"k": np.arange(500), "a": rng.random(500)})
    monkeypatch.setattr(order_stats, "quantiles_of", lambda spark, sketches, ranks: [[0.0] * len(r) for r in ranks])
    assert quantiles_many(spark.createDataFrame(frame), [("a", [0.5])], "k") == [[frame["a"].quantile(0.5)]]


def test_observed_while_written(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("id")))
    kept, found = materialize_observed(df, "observed", rows=F.count("*"), values=F.count("v"), top=F.max("v"))
    assert found == {"rows": 100, "values": 90, "top": 99} and kept.count() == 100
    _, none = materialize_observed(df.where("id < 0"), "observed", rows=F.count("*"), top=F.max("v"))
    assert none == {"rows": 0, "top": None}


def test_rfm_takes_no_job_for_the_date_and_the_counts(spark, monkeypatch):
    """The analysis date and the cuts' counts come with the write of the customers."""
    import custval.operators.quantiles as quantiles

    def never(*args):
        raise AssertionError("a job of its own")

    want = rfm_retail(invoice_lines(spark, SF_SMALL), dt.datetime(1999, 1, 1)).columns
    monkeypatch.setattr(quantiles, "_counts", never)
    collected = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "collect", lambda self, collect=frame.collect: collected.append(1) or collect(self))
    out = rfm_retail(invoice_lines(spark, SF_SMALL))
    assert out.columns == want and len(collected) <= 2  # the positions of the cuts only


def test_month_bitmaps_against_pairs(spark):
    """Months of customers over several eras, before and after 1970, with gaps."""
    rng = np.random.default_rng(8)
    start = dt.date(1964, 11, 1)
    months = [int(m) for m in rng.integers(0, 3 * ERA_MONTHS + 5, 600)] + list(range(2 * ERA_MONTHS))
    rows = [(int(c) if c else None, dt.datetime(start.year + (start.month - 1 + m) // 12, (start.month - 1 + m) % 12 + 1, 9, 23)) for m in months for c in (rng.integers(0, 5),)]
    rows += [(1, None)] + [(9, dt.datetime(2024, 2, 29))] * 50
    df = spark.createDataFrame(rows, "c long, d timestamp_ntz")
    active = {(c, d.year * 12 + d.month - 1) for c, d in rows if c is not None and d is not None}
    got = [(r.customer_id, r.month.year * 12 + r.month.month - 1, r.retained) for r in active_months(activity_bitmaps(df, "c", "d")).collect()]
    assert len(got) == len(active) and {(c, m) for c, m, _ in got} == active
    assert all(kept == ((c, m - 1) in active) for c, m, kept in got)


def test_retention_aggregates_customers_once(spark):
    """One exchange of the customers' rows, of one long each; no window by customer."""
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 5)), (1, dt.datetime(2020, 2, 5)), (2, dt.datetime(2020, 4, 5))], "c long, d timestamp_ntz")
    plan = retention(df, "c", "d")._jdf.queryExecution().executedPlan().toString()
    assert "lag(month" not in plan and not re.search(r"Window .*customer_id", plan)
    by_customer = set(re.findall(r"Exchange hashpartitioning\(customer_id#\d+L?, era#\d+L?", plan))
    assert len(by_customer) == 1
    rows = {r.period: r for r in retention(df, "c", "d").collect()}
    assert [rows[p].active_customers for p in ("2020-01", "2020-02", "2020-03", "2020-04")] == [1, 1, 0, 1]
    assert rows["2020-02"].retention_rate == 1.0 and rows["2020-03"].churn_rate == 1.0 and rows["2020-04"].retention_rate is None


def test_pairs_are_dealt_to_several_tasks(spark):
    inputs = spark.range(1000).selectExpr("id AS customer_id", "id % 50 + 2 AS frequency", "1.0D AS recency", "id % 7 + 9.0D AS T", "5.0D AS monetary")
    plan = score_customers(inputs, CDNOW_BGNBD, CDNOW_GAMMA_GAMMA)._jdf.queryExecution().executedPlan().toString()
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(_x#\d+L?, _T#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert tasks and min(tasks) >= spark.sparkContext.defaultParallelism
    assert 1200 <= scoring_tasks(spark, 100_000_000, 6) <= 1201 and scoring_tasks(spark, None, 6) == max(2, spark.sparkContext.defaultParallelism)


def test_prediction_says_what_its_fits_are():
    from custval.operators.bgnbd import BetaGeoParams, FitResult
    from custval.operators.gammagamma import GammaGammaParams

    good = Prediction(None, FitResult(CDNOW_BGNBD, 1.0, 3, True), FitResult(CDNOW_GAMMA_GAMMA, 1.0, 3, True))
    assert not good.boundary and not good.q_at_most_1 and good.remarks() == []
    bad = Prediction(None, FitResult(BetaGeoParams(1, 1, 1e-9, 1), 1.0, 3, False, True), FitResult(GammaGammaParams(1, 0.5, 1), 1.0, 3, True))
    assert bad.boundary and bad.q_at_most_1 and len(bad.remarks()) == 3


def test_distinct_counts_of_integers_in_one_read(spark):
    """Dense, sparse, negative, extreme and null integers; the text column takes a read of its own."""
    from custval.operators.profile import distinct_counts

    rng = np.random.default_rng(9)
    n = 4000
    frame = pd.DataFrame(
        {
            "dense": rng.integers(0, 1000, n),
            "sparse": rng.integers(-(2**63), 2**63 - 1, n),
            "edges": rng.choice([-(2**63), 2**63 - 1, -1, 0, 63, 64, -64, -65], n),
            "small": rng.integers(-5, 5, n).astype(np.int8),
            "text": rng.choice(list("abcdef"), n),
        }
    )
    df, read = _counted(spark, frame)
    df = df.withColumn("none", F.lit(None).cast("int")).withColumn("some", F.when(F.col("dense") % 2 == 0, F.col("dense")))
    whole = ["dense", "sparse", "edges", "small", "none", "some"]
    got = {r.column_name: r.distinct_count for r in distinct_counts(df, whole).collect()}
    assert read.value == n
    want = {c: frame[c].nunique() for c in whole[:4]} | {"none": 0, "some": frame.loc[frame["dense"] % 2 == 0, "dense"].nunique()}
    assert got == want
    both = {r.column_name: r.distinct_count for r in distinct_counts(df, ["text", "dense"]).collect()}
    assert both == {"text": 6, "dense": want["dense"]}
    assert distinct_counts(df.where("dense < 0"), ["dense", "small"]).toPandas()["distinct_count"].tolist() == [0, 0]


@pytest.mark.parametrize("none", ["Quantity < -5", "1 = 0", "`Customer ID` is null"])
def test_empty_tables_are_observed_too(spark, none):
    """Whether the emptiness shows when the plan is made, or only when it runs."""
    from custval.plans.retail import model_inputs_retail

    lines = invoice_lines(spark, SF_SMALL).where(none)
    with pytest.raises(ValueError, match="last_date"):
        rfm_retail(lines)
    assert rfm_retail(lines, dt.datetime(2000, 1, 1)).count() == 0
    assert model_inputs_retail(lines, dt.datetime(2000, 1, 1)).count() == 0
    rows = describe(lines, ["Quantity", "Price"]).collect()
    assert [(r["count"], r["mean"], r.p50) for r in rows] == [(0, None, None)] * 2
