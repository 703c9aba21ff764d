"""Date functions.

``days_between(a, b)`` is the whole number of days in ``a - b``, rounded
*down* - the ``.days`` of a time difference: 2010-12-11 00:00 minus
2010-12-09 20:01 is 1 day, and 2010-12-11 00:00 minus 2010-12-12 01:00 is -2
days.  ``datediff`` (calendar days) and ``timestampdiff(DAY)`` (truncation
toward zero) both differ from it, so it is written on exact microsecond counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _as_column(value: Column | str | dt.datetime | dt.date) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (dt.datetime, dt.date)):
        return ntz_literal(value)
    return F.col(value)


def ntz_literal(value: dt.datetime | dt.date) -> Column:
    """A timestamp_ntz literal, independent of the session time zone."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def days_between(later: Column | str | dt.datetime, earlier: Column | str | dt.datetime) -> Column:
    """floor((later - earlier) / 1 day) as a long; null if either side is null."""
    micros = F.timestamp_diff(
        "MICROSECOND",
        _as_column(earlier).cast("timestamp_ntz"),
        _as_column(later).cast("timestamp_ntz"),
    )
    # micros / day is correctly rounded and |micros| < 2**53, so floor() is exact.
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("long")


def to_timestamp_columns(df: DataFrame, pattern: str = "date") -> DataFrame:
    """Cast every column whose *name* contains ``pattern`` to timestamp_ntz.

    Text columns are parsed (a bad value fails the query under ANSI mode, as
    the reference's parser fails); timestamp columns pass through unchanged.
    """
    names = [c for c in df.columns if pattern in c]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})
