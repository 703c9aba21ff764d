"""Quantile binning with the exact semantics of ``pandas.qcut``.

``qcut(x, q)`` cuts at the linearly interpolated quantiles k/q (k = 0..q);
bins are ``(e[k-1], e[k]]`` with the minimum put in the first bin, so tied
values always share a bin - unlike ``ntile``, which splits ties, or
``QuantileDiscretizer``, which is approximate and half-open the other way.
Repeated edges raise unless ``duplicates="drop"``.

Only the order statistics next to each edge are needed.  They are found with
:mod:`custval.operators.order_stats` (range partitioning on value + unique
key, no single-partition step), for all columns of a table in one counting
job and one fetching job.  The q+1 edges are interpolated on the driver with
the same floating-point steps pandas uses, and each bin is a literal ``CASE``
over its column - a narrow projection, no join, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from custval.operators.order_stats import NUMERIC, ColumnRequest, PositionRequest, column_values, fetch_positions, sketch_columns
from custval.session import observed

_TIE = "__tie"


class DuplicateEdgesError(ValueError):
    """Raised when quantile edges repeat and ``duplicates="raise"``."""


@dataclass
class Cut:
    """One qcut: ``out`` = bin label of ``col`` among ``q`` quantile bins.

    ``by_rank=True`` cuts the unique ascending rank of ``col`` instead (the
    ``rank(method="first")`` idiom); ties are broken by the table key.
    """

    col: str
    q: int
    labels: Sequence | None = None
    out: str | None = None
    by_rank: bool = False
    duplicates: str = "raise"


def _quantile_points(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    """(lower index, upper index, weight) per probability, as numpy's linear method.

    pandas passes percentages (p * 100) to ``np.percentile``, which divides by
    100 again; the virtual index is ``(n - 1) * p``.
    """
    p = np.true_divide(np.asarray(probs, dtype=np.float64) * 100.0, 100)
    virtual = (n - 1) * p
    lower = np.floor(virtual)
    above = virtual >= n - 1
    lower_pos = np.where(above, n - 1, lower).astype(np.int64)
    upper_pos = np.where(above, n - 1, lower + 1).astype(np.int64)
    # numpy stores -1 for indexes at the end, so the weight there is virtual + 1
    gamma = virtual - np.where(above, -1.0, lower)
    return [(int(a), int(b), float(g)) for a, b, g in zip(lower_pos, upper_pos, gamma)]


def _lerp(a: float, b: float, t: float) -> float:
    """numpy's ``_lerp``: a + (b - a) * t, evaluated from ``b`` when t >= 0.5."""
    a64, b64, t64 = np.float64(a), np.float64(b), np.float64(t)
    diff = b64 - a64
    if t64 >= 0.5:
        return float(b64 - diff * (np.float64(1) - t64))
    return float(a64 + diff * t64)


def _checked_edges(edges: list[float], duplicates: str) -> list[float]:
    unique = list(dict.fromkeys(edges))
    if len(unique) < len(edges) and len(edges) != 2:
        if duplicates == "raise":
            raise DuplicateEdgesError(
                f"Bin edges must be unique: {edges}; pass duplicates='drop' to merge them"
            )
        return unique
    return edges


def _labels(labels: Sequence | None, bins: int) -> list:
    if labels is None:
        return list(range(1, bins + 1))
    if len(labels) != bins:
        raise ValueError(f"{len(labels)} labels given for {bins} bins")
    return list(labels)


def _valid(df: DataFrame, col: str) -> Column:
    x = F.col(col)
    if dict(df.dtypes)[col] in ("double", "float"):
        return x.isNotNull() & ~F.isnan(x)
    return x.isNotNull()


def bin_column(x: Column, cuts: list, labels: list, greater) -> Column:
    """CASE WHEN not greater(x, cut_1) THEN l1 ... ELSE l_last."""
    expr = None
    for cut, label in zip(cuts, labels[:-1]):
        cond = ~greater(x, cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    last = F.lit(labels[-1])
    return last if expr is None else expr.otherwise(last)


def _counts(base: DataFrame, df: DataFrame, cols: list[str]):
    """Non-null counts and approximate distinct counts of several columns, one job."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [
            F.count_if(_valid(df, c)).alias(f"n{i}"),
            F.approx_count_distinct(F.col(c)).alias(f"d{i}"),
        ]
    return base.agg(*aggs).collect()[0]


def _tie_frame(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    if key is not None:
        return df, key
    return df.withColumn(_TIE, F.monotonically_increasing_id()), _TIE


def quantiles_many(
    df: DataFrame,
    requests: Sequence[tuple[str, Sequence[float]]],
    key: str | None = None,
    rows_per_partition: int | None = None,
) -> list[list[float]]:
    """Linearly interpolated quantiles (``Series.quantile``) of several columns.

    ``requests`` holds (column, probabilities) pairs; nulls and NaN are ignored.
    ``key`` (a unique column) breaks ties so range partitions stay balanced.
    Numeric columns take three reads of ``df`` at most, however many they are.
    """
    return quantiles_and_metrics(df, requests, {}, key, rows_per_partition)[0]


def quantiles_and_metrics(
    df: DataFrame,
    requests: Sequence[tuple[str, Sequence[float]]],
    metrics: dict[str, Column],
    key: str | None = None,
    rows_per_partition: int | None = None,
) -> tuple[list[list[float]], dict]:
    """:func:`quantiles_many`, and aggregates of ``df`` that are observed in its first read."""
    observation = Observation() if metrics else None
    base, tie = _tie_frame(df, key)
    seen = base.observe(observation, *[m.alias(name) for name, m in metrics.items()]) if metrics else base
    if any(dict(df.dtypes)[c] not in NUMERIC for c, _ in requests):
        return _quantiles_ranged(seen, df, requests, tie, rows_per_partition), observed(observation, base, metrics) if metrics else {}
    values = [F.when(_valid(df, c), F.col(c)) for c, _ in requests]
    counts, sketches = sketch_columns(seen, values)
    plans = [_quantile_points(n, probs) if n else [] for n, (_, probs) in zip(counts, requests, strict=True)]
    some = [i for i, n in enumerate(counts) if n]
    needed = [[j for a, b, _ in plans[i] for j in (a, b)] for i in some]
    found = column_values(
        base, tie, [ColumnRequest(values[i], counts[i], sketches[i], ps) for i, ps in zip(some, needed, strict=True)], rows_per_partition
    )
    out: list[list[float]] = [[math.nan] * len(probs) for _, probs in requests]
    for i, st in zip(some, found, strict=True):
        if st is None:
            out[i] = _quantiles_ranged(base, df, [requests[i]], tie, rows_per_partition)[0]
        else:
            out[i] = [_lerp(st[a], st[b], g) for a, b, g in plans[i]]
    return out, observed(observation, base, metrics) if metrics else {}


def _quantiles_ranged(base: DataFrame, df: DataFrame, requests: Sequence[tuple[str, Sequence[float]]], tie: str, rows_per_partition: int | None):
    """:func:`quantiles_many` by ordering each column by itself."""
    counts = _counts(base, df, [c for c, _ in requests])
    plans, position_requests = [], []
    for i, (c, probs) in enumerate(requests):
        n = counts[f"n{i}"]
        points = _quantile_points(n, probs) if n else []
        plans.append(points)
        needed = sorted({j for a, b, _ in points for j in (a, b)})
        values = base.filter(_valid(df, c)).select(c, tie)
        position_requests.append(PositionRequest(values, [c, tie], needed, n, True, counts[f"d{i}"]))
    stats = fetch_positions(position_requests, rows_per_partition)
    out = []
    for (c, probs), points, st in zip(requests, plans, stats):
        if not points:
            out.append([math.nan] * len(probs))
        else:
            out.append([_lerp(float(st[a][0]), float(st[b][0]), g) for a, b, g in points])
    return out


def quantiles_exact(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    key: str | None = None,
    rows_per_partition: int | None = None,
) -> list[float]:
    return quantiles_many(df, [(col, probs)], key, rows_per_partition)[0]


def qcut_edges(
    df: DataFrame,
    col: str,
    q: int,
    key: str | None = None,
    duplicates: str = "raise",
    rows_per_partition: int | None = None,
) -> list[float]:
    """The q+1 interpolated bin edges of ``col`` (checked for repeats)."""
    edges = quantiles_many(df, [(col, np.linspace(0, 1, q + 1))], key, rows_per_partition)[0]
    if any(math.isnan(e) for e in edges):
        raise ValueError(f"qcut of {col}: no non-null values")
    return _checked_edges(edges, duplicates)


def bins_from_edges(x: Column, edges: list[float], labels: Sequence | None = None) -> Column:
    """Label of the (e[k-1], e[k]] bin of ``x`` (the first bin includes e[0])."""
    labels = _labels(labels, len(edges) - 1)
    return bin_column(x, edges[1:-1], labels, lambda v, e: v > F.lit(e))


def qcut_many(
    df: DataFrame,
    cuts: Sequence[Cut],
    key: str | None = None,
    rows_per_partition: int | None = None,
    counts: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Add one bin column per :class:`Cut`; all edges found in two jobs.

    ``counts`` holds, where the caller knows them, each column's number of values (neither null nor NaN)
    and its approximate number of distinct values; otherwise a job counts them.
    """
    if any(c.by_rank for c in cuts) and key is None:
        raise ValueError("rank cuts need a unique key column")
    base, tie = _tie_frame(df, key)
    if counts is None:
        row = _counts(base, df, [c.col for c in cuts])
        counts = {c.col: (row[f"n{i}"], row[f"d{i}"]) for i, c in enumerate(cuts)}
    probs = {c.q: np.linspace(0, 1, c.q + 1) for c in cuts}
    plans, position_requests = [], []
    for c in cuts:
        n, distinct = counts[c.col]
        if n == 0:
            # nothing to cut: every bin is null (e.g. a CLV that is null throughout)
            plans.append(None)
            continue
        points = _quantile_points(n, probs[c.q])
        if c.by_rank:
            # ranks are the floats 1..n, so order statistic j is j + 1
            edges = _checked_edges([_lerp(a + 1.0, b + 1.0, g) for a, b, g in points], "raise")
            # rank r <= e  <=>  r <= floor(e)  <=>  row <= the row at floor(e) - 1
            needed = [int(math.floor(e)) - 1 for e in edges[1:-1]]
            plans.append((points, edges, needed))
        else:
            needed = sorted({j for a, b, _ in points for j in (a, b)})
            plans.append((points, None, needed))
        values = base.filter(_valid(df, c.col)).select(c.col, tie)
        position_requests.append(
            PositionRequest(values, [c.col, tie], needed, n, not c.by_rank, distinct)
        )
    stats = iter(fetch_positions(position_requests, rows_per_partition))

    new_cols = {}
    for c, plan in zip(cuts, plans):
        out = c.out or f"{c.col}_bin"
        if plan is None:
            label_type = "string" if c.labels and isinstance(list(c.labels)[0], str) else "int"
            new_cols[out] = F.lit(None).cast(label_type)
            continue
        points, rank_edges, needed = plan
        st = next(stats)
        x = F.col(c.col)
        if c.by_rank:
            labels = _labels(c.labels, len(rank_edges) - 1)
            k = F.col(tie)

            def greater(_, cut, x=x, k=k):
                cv, ck = cut
                return (x > F.lit(cv)) | ((x == F.lit(cv)) & (k > F.lit(ck)))

            binned = bin_column(x, [st[p] for p in needed], labels, greater)
        else:
            edges = [_lerp(float(st[a][0]), float(st[b][0]), g) for a, b, g in points]
            edges = _checked_edges(edges, c.duplicates)
            labels = _labels(c.labels, len(edges) - 1)
            binned = bin_column(x, edges[1:-1], labels, lambda v, e: v > F.lit(e))
        new_cols[out] = F.when(_valid(df, c.col), binned)
    result = base.withColumns(new_cols)
    return result if key is not None else result.drop(_TIE)


def qcut(
    df: DataFrame,
    col: str,
    q: int,
    labels: Sequence | None = None,
    out: str | None = None,
    key: str | None = None,
    duplicates: str = "raise",
    rows_per_partition: int | None = None,
) -> DataFrame:
    """Add ``out`` = the qcut bin label of ``col`` (labels default to 1..q)."""
    return qcut_many(df, [Cut(col, q, labels, out, False, duplicates)], key, rows_per_partition)


def qcut_rank_first(
    df: DataFrame,
    col: str,
    q: int,
    key: str,
    labels: Sequence | None = None,
    out: str | None = None,
    rows_per_partition: int | None = None,
) -> DataFrame:
    """qcut of the unique ascending rank of ``col``, ties broken by ``key``.

    Equivalent to ``qcut(x.rank(method="first"), q)`` on rows ordered by
    ``key``; the rank itself is never materialised - only q-1 rows are fetched.
    """
    return qcut_many(df, [Cut(col, q, labels, out, True)], key, rows_per_partition)
