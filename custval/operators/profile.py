"""Table profiling: null counts, numeric summaries, distinct counts.

Each profile is one aggregation over the table (all columns at once), then a
``stack`` to a long table - a single pass, partial aggregates per partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custval.operators.quantiles import quantiles_and_metrics

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _stack(df_one_row: DataFrame, names: Sequence[str], value_cols: Sequence[str], out: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{v}`" for n, v in zip(names, value_cols))
    return df_one_row.selectExpr(f"stack({len(names)}, {pairs}) AS (column_name, {out})")


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count): nulls, and NaN in float columns, per column."""
    exprs, names = [], []
    for i, (c, t) in enumerate(df.dtypes):
        missing = F.col(c).isNull()
        if t in ("double", "float"):
            missing = missing | F.isnan(F.col(c))
        exprs.append(F.count_if(missing).alias(f"c{i}"))
        names.append(c)
    return _stack(df.agg(*exprs), names, [f"c{i}" for i in range(len(names))], "null_count")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC]


def describe(df: DataFrame, cols: Sequence[str] | None = None, key: str | None = None) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (exact, linear), max per column."""
    cols = list(cols or numeric_columns(df))
    df = df.select(*dict.fromkeys([*cols, key] if key else cols))  # observed rows are not pruned by the optimizer
    metrics = {}
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        metrics |= {f"n{i}": F.count(x), f"mean{i}": F.avg(x), f"std{i}": F.stddev_samp(x), f"min{i}": F.min(x), f"max{i}": F.max(x)}
    quartiles, moments = quantiles_and_metrics(df, [(c, [0.25, 0.5, 0.75]) for c in cols], metrics, key)
    rows = []
    for i, c in enumerate(cols):
        p25, p50, p75 = quartiles[i]
        rows.append(
            (
                c,
                int(moments[f"n{i}"]),
                moments[f"mean{i}"],
                moments[f"std{i}"],
                moments[f"min{i}"],
                None if p25 != p25 else p25,
                None if p50 != p50 else p50,
                None if p75 != p75 else p75,
                moments[f"max{i}"],
            )
        )
    schema = (
        "column_name string, count long, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double"
    )
    # One row per described column: bounded by the schema width.
    return df.sparkSession.createDataFrame(rows, schema)


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """(column_name, distinct_count), nulls not counted.

    Exact counts of all integer columns take one read: a value is a bit of a 64-bit word, words are combined
    by ``bit_or`` before and after the exchange, and their bits counted (a word per 64 neighbouring values, never
    more words than distinct values).  Other columns deduplicate in an aggregate of their own (several exact
    counts in one aggregate would expand every row once per column); ``approx=True``
    uses HyperLogLog sketches instead (one pass, partial aggregation only).
    """
    if approx:
        aggs = [F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)]
        return _stack(df.agg(*aggs), list(cols), [f"d{i}" for i in range(len(cols))], "distinct_count")
    whole = [c for c in cols if dict(df.dtypes)[c] in INTEGERS]
    each = [_integer_counts(df, whole)] if whole else []
    each += [
        df.select(F.col(c).alias("v")).where("v is not null").distinct().agg(F.count("*").alias("distinct_count")).select(
            F.lit(c).alias("column_name"), "distinct_count"
        )
        for c in cols
        if c not in whole
    ]
    return reduce(DataFrame.unionByName, each)


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _integer_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct counts of integer columns, in one read, by bitmaps."""

    def mark(i: int, c: str) -> Column:
        x = F.col(c).cast("long")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        one = F.struct(F.lit(i).alias("tag"), F.shiftright(x, 6).alias("word"), bit.alias("bit"))
        return F.when(x.isNotNull(), one)

    marks = df.select(F.inline(F.array_compact(F.array(*[mark(i, c) for i, c in enumerate(cols)]))))
    words = marks.groupBy("tag", "word").agg(F.bit_or("bit").alias("bits"))
    held = F.bit_count("bits").cast("long")
    counts = words.agg(*[F.coalesce(F.sum(F.when(F.col("tag") == i, held)), F.lit(0).cast("long")).alias(f"d{i}") for i in range(len(cols))])
    return _stack(counts, list(cols), [f"d{i}" for i in range(len(cols))], "distinct_count")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count("*").alias(out))
        .orderBy(F.col(out).desc(), F.col(col))
    )


def latest(df: DataFrame, col: str):
    return df.agg(F.max(col).alias("m")).collect()[0]["m"]
