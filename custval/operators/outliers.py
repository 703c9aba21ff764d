"""Outlier thresholds and capping.

Thresholds are q01 - 1.5 * IQR and q99 + 1.5 * IQR with IQR = q99 - q01
(linear quantiles).  The limits of all requested columns are computed
together (one count job, one order-statistics job); capping is then a narrow
projection with the limits as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custval.operators.quantiles import quantiles_many


def outlier_thresholds(
    df: DataFrame,
    cols: Sequence[str],
    lower_q: float = 0.01,
    upper_q: float = 0.99,
    key: str | None = None,
) -> dict[str, tuple[float, float]]:
    """``{col: (low_limit, up_limit)}``."""
    qs = quantiles_many(df, [(c, [lower_q, upper_q]) for c in cols], key)
    out = {}
    for c, (q1, q3) in zip(cols, qs):
        iqr = q3 - q1
        out[c] = (q1 - 1.5 * iqr, q3 + 1.5 * iqr)
    return out


def cap_upper(
    df: DataFrame, cols: Sequence[str], key: str | None = None
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Replace values above the upper limit by the (unrounded) limit."""
    limits = outlier_thresholds(df, cols, key=key)
    capped = df.withColumns(
        {
            c: F.when(F.col(c) > F.lit(up), F.lit(up)).otherwise(F.col(c).cast("double"))
            for c, (_, up) in limits.items()
        }
    )
    return capped, limits


def cap_both_rounded(
    df: DataFrame, cols: Sequence[str], key: str | None = None
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Replace values outside the limits by the limits rounded to integers.

    The limits are rounded half to even on the driver (Python ``round``), so
    2.5 becomes 2 and 3.5 becomes 4.
    """
    limits = outlier_thresholds(df, cols, key=key)
    new_cols = {}
    for c, (low, up) in limits.items():
        # low cap first, then the upper test on the already-capped value
        first = F.when(F.col(c) < F.lit(low), F.lit(float(round(low, 0)))).otherwise(
            F.col(c).cast("double")
        )
        new_cols[c] = F.when(first > F.lit(up), F.lit(float(round(up, 0)))).otherwise(first)
    return df.withColumns(new_cols), limits
