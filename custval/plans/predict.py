"""Predicted CLV: BG/NBD + Gamma-Gamma fits, predictions, CLV, segments."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custval.operators.bgnbd import (
    BetaGeoParams,
    FitResult,
    alive_odds,
    expected_of_pairs,
    fit_bgnbd,
    probability_of_n_purchases,
)
from custval.operators.gammagamma import (
    GammaGammaParams,
    discount_weights,
    discounted_gain,
    expected_average_profit,
    fit_gamma_gamma,
    purchase_horizons,
)
from custval.operators.quantiles import bins_from_edges, qcut, qcut_edges
from custval.plans.omni import model_inputs_omni
from custval.plans.retail import CLV_LABELS, model_inputs_retail
from custval.session import materialize

RETAIL_HORIZONS = {"expected_purc_1_week": 1, "expected_purc_1_month": 4, "expected_purc_3_month": 12}
OMNI_HORIZONS = {"exp_sales_3_month": 4 * 3, "exp_sales_6_month": 4 * 6}


@dataclass
class Prediction:
    table: DataFrame
    bgnbd: FitResult | None
    gamma_gamma: FitResult | None

    @property
    def boundary(self) -> bool:
        """Whether a fit ended at the boundary of its parameters: the predictions then hang on the penalty."""
        return any(fit is not None and fit.boundary for fit in (self.bgnbd, self.gamma_gamma))

    @property
    def q_at_most_1(self) -> bool:
        """Whether the population mean of the spend does not exist: expected profits are then no shrunk means."""
        return self.gamma_gamma is not None and self.gamma_gamma.params.q <= 1

    def remarks(self) -> list[str]:
        """What a reader of the table should know about the fits."""
        fits = (("BG/NBD", self.bgnbd), ("Gamma-Gamma", self.gamma_gamma))
        out = [f"the {name} fit did not converge" for name, fit in fits if fit is not None and not fit.converged]
        out += [f"the {name} fit ended at the boundary of its parameters" for name, fit in fits if fit is not None and fit.boundary]
        return out + ["Gamma-Gamma q <= 1: expected profits are no shrunk means"] * self.q_at_most_1


#: What the expected purchases of a pair cost within one time, and what a task should take, in seconds.
PAIR_SECONDS = 20e-6
TASK_SECONDS = 10.0


def scoring_tasks(spark: SparkSession, rows: int | None, times: int) -> int:
    """Tasks for the pairs: as many as run at once, more if ``rows`` pairs would keep them longer than TASK_SECONDS."""
    return max(2, spark.sparkContext.defaultParallelism, math.ceil((rows or 0) * times * PAIR_SECONDS / TASK_SECONDS))


def score_customers(
    inputs: DataFrame,
    bg: BetaGeoParams,
    gg: GammaGammaParams,
    cols: tuple[str, str, str, str] = ("frequency", "recency", "T", "monetary"),
    horizons: dict[str, float] | None = None,
    profit_col: str = "expected_average_profit",
    months: int = 3,
    discount_rate: float = 0.01,
    freq: str = "W",
    rows: int | None = None,
) -> DataFrame:
    """Add expected purchases per horizon, expected profit and discounted CLV.

    What a live customer is expected to buy depends on (frequency, T) only: it is
    evaluated once for each distinct pair and joined back (the pairs are few where
    customers are many; the strategy is left to Spark), recency enters row by row.
    ``rows`` bounds the number of pairs, if known: the pairs are dealt to tasks by what they cost.
    """
    x, tx, age, m = cols
    horizons = RETAIL_HORIZONS if horizons is None else horizons
    times = [*map(float, horizons.values()), *purchase_horizons(months, freq)]
    pairs = inputs.select(F.col(x).alias("_x"), F.col(age).alias("_T")).distinct()
    gains = expected_of_pairs(bg, times, pairs, scoring_tasks(inputs.sparkSession, rows, len(times))).withColumnRenamed("gains", "_gains")
    gained = inputs.join(gains, (F.col(x) == F.col("_x")) & (F.col(age) == F.col("_T")), "left")
    odds = alive_odds(bg, x, tx, age)
    profit = expected_average_profit(gg, x, m)
    monthly = F.slice("_gains", len(horizons) + 1, months)
    clv = profit * discounted_gain(monthly, discount_weights(months, discount_rate, freq)) / odds
    return gained.select(
        *inputs.columns,
        *[(F.col("_gains")[i] / odds).alias(name) for i, name in enumerate(horizons)],
        profit.alias(profit_col),
        clv.alias("clv"),
    )


def clv_predict(
    inputs: DataFrame,
    cols: tuple[str, str, str, str] = ("frequency", "recency", "T", "monetary"),
    horizons: dict[str, float] | None = None,
    profit_col: str = "expected_average_profit",
    months: int = 3,
    segment_col: str = "segment",
    bg_penalizer: float = 0.001,
    gg_penalizer: float = 0.01,
    discount_rate: float = 0.01,
    freq: str = "W",
    labels: Sequence[str] = CLV_LABELS,
) -> Prediction:
    """Fit both models on ``inputs``, score every customer, cut CLV quartiles."""
    x, tx, age, m = cols
    bg = fit_bgnbd(inputs, x, tx, age, bg_penalizer)
    gg = fit_gamma_gamma(inputs, x, m, gg_penalizer)
    scored = materialize(
        score_customers(inputs, bg.params, gg.params, cols, horizons, profit_col, months, discount_rate, freq, bg.rows),
        "clv_scored",
    )
    segmented = qcut(scored, "clv", len(labels), list(labels), segment_col, "customer_id")
    return Prediction(segmented, bg, gg)


def clv_predict_retail(
    lines: DataFrame,
    months: int = 3,
    analysis_date: dt.datetime | None = None,
    horizons: dict[str, float] | None = None,
    bg_penalizer: float = 0.001,
    gg_penalizer: float = 0.01,
    discount_rate: float = 0.01,
    repeat_only: bool = True,
) -> Prediction:
    """Predicted CLV from invoice lines.

    ``horizons`` names expected-purchase columns and their weeks (default 1, 4 and
    12); ``analysis_date`` defaults to two days after the latest invoice.
    """
    return clv_predict(
        model_inputs_retail(lines, analysis_date, repeat_only=repeat_only),
        horizons=horizons,
        months=months,
        bg_penalizer=bg_penalizer,
        gg_penalizer=gg_penalizer,
        discount_rate=discount_rate,
    )


OMNI_COLS = ("frequency", "recency_clv_weekly", "T_weekly", "monetary_clv_avg")


def clv_predict_omni(
    summary: DataFrame,
    months: int = 6,
    split_top: bool = False,
    repeat_only: bool = True,
    analysis_date: dt.datetime | None = None,
    horizons: dict[str, float] | None = None,
    bg_penalizer: float = 0.001,
    gg_penalizer: float = 0.01,
    discount_rate: float = 0.01,
) -> Prediction:
    """Omnichannel predicted CLV.

    The defaults follow the function form; ``repeat_only=False, split_top=True``
    follow the script form (no zero-value / frequency filters, A split in two).
    """
    pred = clv_predict(
        model_inputs_omni(summary, analysis_date, repeat_only=repeat_only),
        OMNI_COLS,
        OMNI_HORIZONS if horizons is None else horizons,
        "exp_average_value",
        months,
        "clv_segment",
        bg_penalizer,
        gg_penalizer,
        discount_rate,
    )
    if split_top:
        pred.table = split_top_segment(pred.table)
    return pred


def merge_by_key(left: DataFrame, right: DataFrame, key: str = "customer_id") -> DataFrame:
    """Left merge of a result (one row per key) onto a table; columns that both have keep the left values."""
    new = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*new), key, "left")


def calibration(
    params: BetaGeoParams, inputs: DataFrame, max_frequency: int = 7, frequency: str = "frequency", T: str = "T"
) -> DataFrame:
    """Customers per transaction count, observed and expected under the model: frequency, actual, expected.

    The last row, ``max_frequency``, holds that count and all above it.
    """
    probs = [probability_of_n_purchases(params, T, n) for n in range(max_frequency)]
    tail = F.lit(1.0) - sum(probs[1:], probs[0])
    each = [F.sum(p).alias(f"e{n}") for n, p in enumerate([*probs, tail])]
    counts = [F.count_if(F.col(frequency) == n).alias(f"a{n}") for n in range(max_frequency)]
    row = inputs.agg(*each, *counts, F.count_if(F.col(frequency) >= max_frequency).alias(f"a{max_frequency}"))
    stack = ", ".join(f"{n}, a{n}, e{n}" for n in range(max_frequency + 1))
    return row.selectExpr(f"stack({max_frequency + 1}, {stack}) AS (frequency, actual, expected)")


def split_top_segment(
    df: DataFrame,
    clv: str = "clv",
    segment: str = "clv_segment",
    top: str = "A",
    labels: Sequence[str] = ("A2", "A1"),
    key: str = "customer_id",
) -> DataFrame:
    """Split the top segment in two by the median of its own CLV values.

    Other segments keep their label; one row per customer (a label column,
    not a join on the floating CLV value).
    """
    edges = qcut_edges(df.filter(F.col(segment) == top), clv, len(labels), key)
    sub = bins_from_edges(F.col(clv), edges, list(labels))
    return df.withColumn(segment, F.when(F.col(segment) == top, sub).otherwise(F.col(segment)))


def fit_table(spark, result: FitResult, model: str) -> DataFrame:
    """Parameters of a fit as rows (parameter, value) plus fit diagnostics."""
    params = vars(result.params)
    rows = [(model, k, float(v)) for k, v in params.items()]
    rows += [(model, f"{k}_se", None if v is None else float(v)) for k, v in (result.errors or {}).items()]
    rows.append((model, "objective", float(result.objective)))
    rows.append((model, "iterations", float(result.iterations)))
    rows.append((model, "converged", 1.0 if result.converged else 0.0))
    rows.append((model, "boundary", 1.0 if result.boundary else 0.0))
    if "q" in params:  # 1: the population mean of the spend does not exist
        rows.append((model, "q_at_most_1", 1.0 if params["q"] <= 1 else 0.0))
    # a handful of rows: one per model parameter
    return spark.createDataFrame(rows, "model string, parameter string, value double")
