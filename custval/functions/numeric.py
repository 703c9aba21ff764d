"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null when den is 0 (plain ``/`` raises under ANSI mode)."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))




def sig_round(c: Column | str, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits.

    For presenting order-dependent aggregates (floating sums, means) stably:
    x is scaled by an exact power of ten (multiplying when the exponent is
    non-negative, dividing otherwise), rounded half away from zero, scaled back.
    Exact decimal ties (means of cents, say) would fall to either side with the last bit
    of a sum, so x is first moved away from zero by a part in 2**41, far below the digits kept.
    """
    x = col_of(c).cast("double") * F.lit(1.0 + 2.0**-41)
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    up = F.pow(F.lit(10.0), k)
    down = F.pow(F.lit(10.0), -k)
    scaled = F.when(k >= 0, F.round(x * up) / up).otherwise(F.round(x / down) * down)
    return F.when(x.isNull() | F.isnan(x) | (x == 0) | F.isnan(F.abs(x) - F.abs(x)), x).otherwise(scaled)
