"""Exact order statistics and global ranks without a single-partition window.

``Window.orderBy(...)`` with no partition key plans ``Exchange SinglePartition``:
every row goes to one task.  Here the table is range-partitioned on a *total*
order (the order columns end with a unique key, so no value - however common -
can pile into one partition), each partition is sorted locally and numbered
with ``monotonically_increasing_id`` (partition index in the upper 31 bits,
position in the lower 33).  A tiny per-partition count gives the offsets;
then

* :func:`fetch_positions` fetches the handful of rows at given global
  positions (only those rows reach the driver), batching any number of
  requests into one counting job and one fetching job, and
* :func:`global_rank` adds an exact 1-based rank column by joining the
  per-partition offsets (one row per partition) back.

For large inputs whose leading order column has few distinct values (checked
with ``approx_count_distinct``, then with a bounded collect), a value histogram
replaces the range shuffle: ``groupBy(value).count()`` aggregates partially on
every task, the driver walks the cumulative counts, and - when the remaining
order columns matter (rank cuts) - only the tie group of the boundary value is
range-partitioned on its (unique) key.

Very large value-only requests (a quantile of a line-level column, say) are
first narrowed to brackets by an approximate quantile sketch; exact counts
verify each bracket and only its rows are ordered, so the whole column is
never shuffled.  Quantiles of several columns of a table share their reads
(:func:`sketch_columns`, :func:`column_values`): one for counts and sketches, one for
all brackets' counts, one for the few rows inside them.

The partition count grows with the row count (``ROWS_PER_PARTITION`` rows
each).  With more than one partition the ranged table is persisted between the
counting and the fetching job so both see the same partitioning; a lost block
is recomputed from the same shuffle dependency (same range bounds), so
positions stay stable.  With one partition the position is global already and
a single job suffices.
"""

from __future__ import annotations

import bisect
import decimal
import math
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custval.session import materialize

ROWS_PER_PARTITION = 1_000_000
# Most distinct values a histogram may have; more falls back to range partitioning.
HISTOGRAM_LIMIT = 200_000
# Value-only requests over more rows than this first narrow each position to a
# bracket with an approximate quantile sketch, verify it with exact counts, and
# sort only the bracket.
BRACKET_MIN_ROWS = 4 * ROWS_PER_PARTITION
# KLL sketch size; the rank error is about 2.3 / k ** 0.9 of the rows.  Sketches of
# scan tasks merge in this many groups first, then the groups' ones.
SKETCH_K = 8192
SKETCH_GROUPS = 512
_POS = "__pos"
_PID_SHIFT = 33


def partitions_for(n: int, rows_per_partition: int | None = None) -> int:
    per = rows_per_partition or ROWS_PER_PARTITION
    return max(1, math.ceil(n / per))


@dataclass
class PositionRequest:
    """Rows at 0-based ``positions`` of ``df`` sorted ascending by ``order_cols``.

    ``order_cols`` must be a total order (end it with a unique key); ``n`` is
    the row count of ``df``.
    """

    df: DataFrame
    order_cols: list[str]
    positions: list[int]
    n: int
    value_only: bool = False  # only order_cols[0] is needed in the result
    approx_distinct: int | None = None  # of order_cols[0], if already known


def _ranged(df: DataFrame, order_cols: list[str], parts: int) -> DataFrame:
    ordered = [F.col(c).asc_nulls_first() for c in order_cols]
    return (
        df.repartitionByRange(parts, *ordered)
        .sortWithinPartitions(*ordered)
        .withColumn(_POS, F.monotonically_increasing_id())
    )


def _pid() -> "F.Column":
    return F.shiftright(F.col(_POS), _PID_SHIFT)


_DECODERS = {
    "bigint": int,
    "int": int,
    "smallint": int,
    "tinyint": int,
    "double": float,
    "float": float,
    "string": str,
}


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _decoder(dtype: str):
    if dtype.startswith("decimal"):
        return decimal.Decimal
    if dtype not in _DECODERS:
        raise TypeError(f"order statistics of {dtype} columns are not supported")
    return _DECODERS[dtype]


def fetch_positions(
    requests: list[PositionRequest],
    rows_per_partition: int | None = None,
    histogram_limit: int | None = None,
) -> list[dict[int, tuple]]:
    """For each request, ``{position: tuple(order_cols values)}``.

    Requests that fit one partition are sorted in one task; larger ones use the
    value histogram when the leading column has few distinct values, else the
    range-partitioned path.  Value-only requests whose column repeats a lot
    (distinct values at most 1/8 of the rows) use the histogram at any size.
    With ``value_only`` the tie columns of the result are None.
    """
    limit = HISTOGRAM_LIMIT if histogram_limit is None else histogram_limit
    results: list[dict[int, tuple] | None] = [None] * len(requests)

    def histogram_candidate(r: PositionRequest) -> bool:
        if not r.positions or limit <= 0:
            return False
        if partitions_for(r.n, rows_per_partition) > 1:
            return True
        # one partition: a histogram still beats sorting when values repeat a lot
        return r.value_only and r.approx_distinct is not None and r.approx_distinct * 8 <= r.n

    large = [i for i, r in enumerate(requests) if histogram_candidate(r)]
    if large:
        unknown = [i for i in large if requests[i].approx_distinct is None]
        distinct = {i: requests[i].approx_distinct for i in large if i not in unknown}
        if unknown:
            approx = reduce(
                DataFrame.unionByName,
                [
                    requests[i]
                    .df.agg(F.approx_count_distinct(requests[i].order_cols[0]).alias("d"))
                    .withColumn("req", F.lit(i))
                    for i in unknown
                ],
            ).collect()
            distinct.update({row["req"]: row["d"] for row in approx})
        few = [i for i in large if distinct[i] <= limit]
        hist = _histograms([requests[i] for i in few], limit)
        for i, h in zip(few, hist):
            if h is not None:
                results[i] = _from_histogram(requests[i], h, rows_per_partition, limit)
    for i, r in enumerate(requests):
        if (
            results[i] is None
            and r.value_only
            and r.positions
            and r.n > BRACKET_MIN_ROWS
            and dict(r.df.dtypes)[r.order_cols[0]] in NUMERIC
        ):
            results[i] = _from_brackets(r, rows_per_partition)
    rest = [i for i, r in enumerate(results) if r is None]
    ranged = _fetch_ranged([requests[i] for i in rest], rows_per_partition)
    for i, r in zip(rest, ranged):
        results[i] = r
    return results


def _histograms(requests: list[PositionRequest], limit: int) -> list[list[tuple] | None]:
    """Sorted (value, count) lists, or None where more than ``limit`` values exist."""
    if not requests:
        return []
    frames = []
    for i, req in enumerate(requests):
        col = req.order_cols[0]
        frames.append(
            req.df.groupBy(col)
            .agg(F.count("*").alias("n"))
            .limit(limit + 1)
            .select(F.lit(i).alias("req"), F.col(col).cast("string").alias("v"), "n")
        )
    out: list[list[tuple]] = [[] for _ in requests]
    for row in reduce(DataFrame.unionByName, frames).collect():
        out[row["req"]].append((row["v"], row["n"]))
    hists: list[list[tuple] | None] = []
    for req, pairs in zip(requests, out):
        if len(pairs) > limit:
            hists.append(None)
            continue
        dec = _decoder(dict(req.df.dtypes)[req.order_cols[0]])
        hists.append(sorted(((None if v is None else dec(v)), n) for v, n in pairs))
    return hists


def _from_histogram(
    req: PositionRequest, hist: list[tuple], rows_per_partition: int | None, limit: int
) -> dict[int, tuple]:
    starts, total = [], 0
    for _, cnt in hist:
        starts.append(total)
        total += cnt
    if total != req.n:
        raise ValueError(f"expected {req.n} rows, found {total}")
    col, rest = req.order_cols[0], req.order_cols[1:]
    found: dict[int, tuple] = {}
    by_group: dict[int, list[int]] = {}
    for p in sorted(set(req.positions)):
        j = bisect.bisect_right(starts, p) - 1
        if req.value_only or not rest:
            found[p] = (hist[j][0],) + (None,) * len(rest)
        else:
            by_group.setdefault(j, []).append(p)
    # only the tie groups holding wanted positions are ordered by the other columns
    groups = sorted(by_group)
    tie_requests = [
        PositionRequest(
            req.df.filter(F.col(col) == F.lit(hist[j][0])),
            rest,
            [p - starts[j] for p in by_group[j]],
            hist[j][1],
            value_only=len(rest) == 1,  # a one-column order: the value is the whole row
        )
        for j in groups
    ]
    if tie_requests:
        for j, res in zip(groups, fetch_positions(tie_requests, rows_per_partition, limit)):
            for p in by_group[j]:
                found[p] = (hist[j][0],) + res[p - starts[j]]
    return found


def _from_brackets(req: PositionRequest, rows_per_partition: int | None) -> dict[int, tuple] | None:
    """Exact values at positions through :func:`column_values`; None if the sketch misses."""
    x = F.col(req.order_cols[0])
    _, (sketch,) = sketch_columns(req.df, [x])
    (values,) = column_values(req.df, req.order_cols[-1], [ColumnRequest(x, req.n, sketch, req.positions)], rows_per_partition)
    rest = (None,) * (len(req.order_cols) - 1)
    decode = _decoder(dict(req.df.dtypes)[req.order_cols[0]])
    return None if values is None else {p: (decode(v), *rest) for p, v in values.items()}


def sketch_columns(base: DataFrame, values: list[Column]) -> tuple[list[int], list[bytes]]:
    """Non-null counts and KLL sketches of several numeric columns, in one read of ``base``.

    Every scan task sketches its rows; tasks' sketches merge in SKETCH_GROUPS groups,
    so that no task reads more than a share of them, and the groups' sketches at the end.
    One sketch per column, a few hundred KB at most, reaches the driver.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")
    rows = base.select(*[v.cast("double").alias(f"x{i}") for i, v in enumerate(values)], group)
    many = range(len(values))
    level = rows.groupBy("g").agg(
        *[F.count(f"x{i}").alias(f"n{i}") for i in many], *[F.kll_sketch_agg_double(f"x{i}", F.lit(SKETCH_K)).alias(f"s{i}") for i in many]
    )
    row = level.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in many], *[F.kll_merge_agg_double(f"s{i}", F.lit(SKETCH_K)).alias(f"s{i}") for i in many]).first()
    return [row[f"n{i}"] or 0 for i in many], [row[f"s{i}"] for i in many]


def quantiles_of(spark: SparkSession, sketches: list[bytes], ranks: list[list[float]]) -> list[list[float]]:
    """Values at the ranks (0 to 1) of each sketch; a local relation, no job."""
    if not sketches:
        return []
    one = spark.createDataFrame([tuple(map(bytearray, sketches))], ", ".join(f"s{i} binary" for i in range(len(sketches))))
    parts = [F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(float(r)) for r in rs])).alias(f"v{i}") for i, rs in enumerate(ranks)]
    return [list(v) for v in one.select(*parts).first()]


def sketch_quantiles(df: DataFrame, col: str, ranks: list[float]) -> list[float]:
    """Approximate values of one column at the ranks (0 to 1)."""
    _, sketches = sketch_columns(df, [F.col(col)])
    return quantiles_of(df.sparkSession, sketches, [ranks])[0]


@dataclass
class ColumnRequest:
    """The values at 0-based ``positions`` of the ascending non-null values of ``value``, of which there are ``n``."""

    value: Column
    n: int
    sketch: bytes
    positions: list[int]


def column_values(base: DataFrame, tie: str, requests: list[ColumnRequest], rows_per_partition: int | None = None) -> list[dict[int, float] | None]:
    """Exact values at positions of several columns of ``base``, with at most two reads for all of them.

    For neighbouring positions a sketch gives values lo <= hi around their ranks.  One aggregate counts, for every
    such bracket, the rows below lo, at lo, between, and at hi: positions at lo or hi are settled, however many
    rows share the value.  Few rows lie strictly between; those of all brackets and columns are written in one tagged
    read and ordered by (value, ``tie``).  None for a column whose sketch missed (to be ordered in full).
    """
    spark = base.sparkSession
    brackets = [_joined_positions(r.positions, r.n) for r in requests]
    bounds = quantiles_of(
        spark, [r.sketch for r in requests], [[q for _, low, high in bs for q in (low, high)] or [0.0] for bs in brackets]
    )
    todo = [(i, ps, v[2 * j], v[2 * j + 1]) for i, (bs, v) in enumerate(zip(brackets, bounds, strict=True)) for j, (ps, _, _) in enumerate(bs)]
    if not todo:
        return [{} for _ in requests]
    value = [r.value.cast("double") for r in requests]
    between = [(value[i] > F.lit(lo)) & (value[i] < F.lit(hi)) for i, _, lo, hi in todo]
    counts = base.agg(
        *[
            F.count_if(test).alias(f"c{j}_{k}")
            for j, (i, _, lo, hi) in enumerate(todo)
            for k, test in enumerate((value[i] < F.lit(lo), value[i] == F.lit(lo), between[j], (value[i] == F.lit(hi)) & F.lit(lo < hi)))
        ]
    ).first()
    found: list[dict[int, float] | None] = [{} for _ in requests]
    inner: dict[int, list[tuple[int, int]]] = {}
    for j, (i, positions, lo, hi) in enumerate(todo):
        below, low, mid, high = (counts[f"c{j}_{k}"] for k in range(4))
        for p in positions:
            if found[i] is None:
                continue
            at = p - below
            if not 0 <= at < low + mid + high:
                found[i] = None
            elif at < low:
                found[i][p] = lo
            elif at >= low + mid:
                found[i][p] = hi
            else:
                inner.setdefault(j, []).append((p, at - low))
    inner = {j: ps for j, ps in inner.items() if found[todo[j][0]] is not None}
    if inner:
        tagged = [F.when(between[j], F.struct(F.lit(j).alias("tag"), value[todo[j][0]].alias("x"), F.col(tie).alias("k"))) for j in inner]
        near = materialize(base.select(F.inline(F.array_compact(F.array(*tagged)))), "brackets")
        subs = [PositionRequest(near.where(F.col("tag") == j), ["x", "k"], [at for _, at in ps], counts[f"c{j}_2"], True) for j, ps in inner.items()]
        for (j, ps), res in zip(inner.items(), fetch_positions(subs, rows_per_partition), strict=True):
            for p, at in ps:
                found[todo[j][0]][p] = res[at][0]
    return found


def _joined_positions(positions: list[int], n: int) -> list[tuple[list[int], float, float]]:
    """(positions, lowest rank, highest rank) of brackets: neighbours share one."""
    slack = int(n * 2.3 / SKETCH_K**0.9) + 2
    out: list[tuple[list[int], float, float]] = []
    for p in sorted(set(positions)):
        high = min(1.0, (p + slack + 1) / n)
        if out and p - out[-1][0][-1] <= 1:
            out[-1] = ([*out[-1][0], p], out[-1][1], high)
        else:
            out.append(([p], max(0.0, (p - slack) / n), high))
    return out


def _fetch_ranged(
    requests: list[PositionRequest], rows_per_partition: int | None = None
) -> list[dict[int, tuple]]:
    prepared, persisted = [], []
    try:
        for req in requests:
            positions = sorted({int(p) for p in req.positions})
            if positions and (positions[0] < 0 or positions[-1] >= req.n):
                raise IndexError(f"positions {positions} outside 0..{req.n - 1}")
            parts = partitions_for(req.n, rows_per_partition)
            ranked = _ranged(req.df.select(*req.order_cols), req.order_cols, parts)
            if parts > 1:
                ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
                persisted.append(ranked)
            prepared.append((req, positions, parts, ranked))

        # One job: per-partition sizes of every multi-partition request.
        sizes: dict[int, dict[int, int]] = {}
        multi = [
            ranked.groupBy(_pid().alias("pid")).agg(F.count("*").alias("n")).withColumn("req", F.lit(i))
            for i, (_, _, parts, ranked) in enumerate(prepared)
            if parts > 1
        ]
        if multi:
            for row in reduce(DataFrame.unionByName, multi).collect():
                sizes.setdefault(row["req"], {})[row["pid"]] = row["n"]

        # One job: the wanted rows of every request, values carried as text.
        frames, wanted_by_req = [], []
        for i, (req, positions, parts, ranked) in enumerate(prepared):
            if parts == 1:
                wanted = {p: p for p in positions}
            else:
                pids = sorted(sizes[i])
                starts, total = [], 0
                for pid in pids:
                    starts.append(total)
                    total += sizes[i][pid]
                if total != req.n:
                    raise ValueError(f"expected {req.n} rows, found {total}")
                wanted = {}
                for p in positions:
                    j = bisect.bisect_right(starts, p) - 1
                    wanted[(pids[j] << _PID_SHIFT) + (p - starts[j])] = p
            wanted_by_req.append(wanted)
            if wanted:
                frames.append(
                    ranked.filter(F.col(_POS).isin(list(wanted))).select(
                        F.lit(i).alias("req"),
                        F.col(_POS).alias("pos"),
                        F.array(*[F.col(c).cast("string") for c in req.order_cols]).alias("vals"),
                    )
                )
        rows = reduce(DataFrame.unionByName, frames).collect() if frames else []
    finally:
        for ranked in persisted:
            ranked.unpersist()

    results: list[dict[int, tuple]] = [{} for _ in requests]
    decoders = [
        [_decoder(t) for _, t in req.df.select(*req.order_cols).dtypes] for req in requests
    ]
    for row in rows:
        i = row["req"]
        values = tuple(
            None if v is None else dec(v) for dec, v in zip(decoders[i], row["vals"])
        )
        results[i][wanted_by_req[i][row["pos"]]] = values
    return results


def rows_at_positions(
    df: DataFrame,
    order_cols: list[str],
    positions: list[int],
    n: int | None = None,
    rows_per_partition: int | None = None,
) -> dict[int, tuple]:
    """Single-request form of :func:`fetch_positions`."""
    if n is None:
        n = df.count()
    return fetch_positions(
        [PositionRequest(df, order_cols, positions, n)], rows_per_partition
    )[0]


def global_rank(
    df: DataFrame,
    order_cols: list[str],
    rank_col: str = "rank",
    rows_per_partition: int | None = None,
) -> DataFrame:
    """``df`` with an exact 1-based unique rank in ascending ``order_cols``.

    The same result as ``row_number().over(Window.orderBy(*order_cols))`` but
    executed as one range shuffle plus a join with a one-row-per-partition
    offset table.  ``order_cols`` must be a total order.  The numbered table is
    written to the checkpoint folder, so the positions are fixed data.
    """
    spark = df.sparkSession
    n = df.count()
    ranked = materialize(_ranged(df, order_cols, partitions_for(n, rows_per_partition)), "ranked")
    sizes = ranked.groupBy(_pid().alias("pid")).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["pid"]):
        starts.append((row["pid"], total))
        total += row["n"]
    # One row per partition: its size is bounded by the partition count.
    offsets = spark.createDataFrame(starts, "pid long, start long")
    local = F.col(_POS) - F.shiftleft(_pid(), _PID_SHIFT)
    return (
        ranked.withColumn("pid", _pid())
        .join(F.broadcast(offsets), "pid")
        .withColumn(rank_col, F.col("start") + local + 1)
        .drop("pid", "start", _POS)
    )
