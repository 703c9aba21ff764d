"""Mixing sources to target weights by min-cost flow over membership patterns.

A text that several sources hold belongs to all of them; its membership pattern is
the set of these sources.  Documents are aggregated by pattern, and the flow runs
from the patterns to the sources:

* a source asks for its target (weights of the whole, stopped at ``max_repeat`` times
  the source, the excess reshared);
* a pattern may send a source at most ``max_repeat`` times the words of its documents there;
* the first use of a pattern's distinct words is free, the second costs 1 a word, the
  third and fourth 2, and so on (a convex cost), whichever source asks for them.

Because the cost depends on each pattern's total only, the flow of least cost is found
level by level: all that can be routed at cost 0, then what more can be at cost 1, ...
with flow re-routed between sources where that helps.  Only the patterns' sums reach
the driver, in Arrow and numpy arrays of one element per pattern and source of it:
every pattern is kept apart, so these arrays grow with the number of patterns.  Every
document step is a Spark job.

Each cell of pattern and source then takes whole passes of its documents, and the
rest by documents in a seeded order, found by counting words in ranges of the seeded
hash and ordering only the range where the rest ends; the last document is taken in
part.  Reruns agree.

Defined results: a null text has size 0 and nothing is taken of it; a null source is
a source, the last; a source without words has target 0; repeated rows are documents
of their own (ties in the seeded order are equal rows); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custval.llm.common import WORD, keyed
from custval.session import materialize

#: Documents of the range that is put in order.
RANGE_ROWS = 4096


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, max_repeat: float) -> list[float]:
    """Targets by weight that stop at ``max_repeat`` times the size, the excess reshared by weight."""
    target = [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    rest = float(total)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * unit > max_repeat * sizes[i]]
        if not full:
            for i in open_:
                target[i] = weights[i] * unit
            break
        for i in full:
            target[i] = float(max_repeat * sizes[i])
            rest -= target[i]
            open_.discard(i)
    return target


def least_cost_flow(distinct: np.ndarray, capacity: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """``cell_flow`` of a dense table of capacities (patterns x sources)."""
    source, pattern = np.nonzero(capacity.T)
    flow = np.zeros_like(capacity)
    flow[pattern, source] = cell_flow(distinct, pattern, source, capacity[pattern, source], demand)
    return flow


def cell_flow(distinct: np.ndarray, pattern: np.ndarray, source: np.ndarray, capacity: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Flow that meets the sources' demands at least convex cost, as far as capacities allow.

    One element per cell of pattern and source, ordered by source, then pattern.
    ``distinct``: words of each pattern that one use covers.  At level k a pattern may
    have sent 2**k times these.
    """
    flow = np.zeros(len(capacity), np.int64)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, pattern, capacity)
    start = np.searchsorted(source, np.arange(len(demand) + 1))
    level = 0
    while True:
        limit = distinct * 2**level
        _saturate(flow, pattern, start, capacity, np.minimum(limit, total), demand)
        if (_sums(flow, start) >= demand).all() or (limit >= total).all():
            return flow
        level += 1


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each source's sum over its cells."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[start])


def _saturate(flow: np.ndarray, pattern: np.ndarray, start: np.ndarray, capacity: np.ndarray, limit: np.ndarray, demand: np.ndarray) -> None:
    """Augment ``flow`` to a maximum one under the patterns' limits, along shortest paths between sources."""
    cells = [slice(lo, hi) for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]

    def fill(room: np.ndarray, amount: int) -> np.ndarray:
        before = np.cumsum(room) - room
        return np.clip(amount - before, 0, room)

    def spread(s: int, values: np.ndarray) -> np.ndarray:
        """Values of a source's cells, by pattern."""
        out = np.zeros(len(limit), np.int64)
        out[pattern[cells[s]]] = values
        return out

    def unused() -> np.ndarray:
        sent = np.zeros(len(limit), np.int64)
        np.add.at(sent, pattern, flow)
        return limit - sent

    while True:
        need = demand - _sums(flow, start)
        spare = unused()
        if not (need > 0).any() or not (spare > 0).any():
            return
        # sources that unused words reach directly, then through words moved from one source to another
        entry = _sums(np.minimum(spare[pattern], capacity - flow).clip(0), start)
        came: dict[int, int] = {s: -1 for s in range(len(cells)) if entry[s] > 0}
        front, goal = list(came), next((s for s in came if need[s] > 0), None)
        while goal is None and front:
            reached = []
            for s in front:
                moves = _sums(np.minimum(spread(s, flow[cells[s]])[pattern], capacity - flow), start)
                for t in range(len(cells)):
                    if t not in came and moves[t] > 0:
                        came[t] = s
                        reached.append(t)
            front, goal = reached, next((t for t in reached if need[t] > 0), None)
        if goal is None:
            return
        path = [goal]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])

        def movable(s: int, t: int) -> np.ndarray:
            """Words that each cell of t can take over from s."""
            to = cells[t]
            return np.minimum(spread(s, flow[cells[s]])[pattern[to]], capacity[to] - flow[to])

        amount = min(int(need[goal]), int(entry[path[-1]]))
        for t, s in zip(path, path[1:], strict=False):
            amount = min(amount, int(movable(s, t).sum()))
        for t, s in zip(path, path[1:], strict=False):  # from the goal backwards: each source passes on what it will get
            moved = fill(movable(s, t), amount)
            flow[cells[t]] += moved
            flow[cells[s]] -= spread(t, moved)[pattern[cells[s]]]
        first = cells[path[-1]]
        flow[first] += fill(np.minimum(unused()[pattern[first]], capacity[first] - flow[first]).clip(0), amount)


def _whole(targets: list[float]) -> np.ndarray:
    """Targets in whole words, the sum rounded once."""
    down = np.floor(np.array(targets)).astype(np.int64)
    more = int(round(sum(targets))) - int(down.sum())
    order = np.argsort(-(np.array(targets) - down), kind="stable")
    down[order[:more]] += 1
    return down


def mix(
    docs: DataFrame,
    weights: Sequence[float],
    share: float = 1.0,
    max_repeat: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[Column] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words), then ``carry``.

    Sources in code-point order (null last) get the weights in turn, repeating;
    together they ask for ``share`` of all words.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    extra = {f"carry_{i}": c for i, c in enumerate(carry)}
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    rows = materialize(keyed(docs, doc_id=id_col, source=source_col, size=size, text_key=key, **extra), "sizes")

    by_source = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row per source
    by_source.sort(key=lambda r: (r.source is None, r.source or ""))
    names, sizes = [r.source for r in by_source], [r["size"] for r in by_source]
    of = [float(weights[i % len(weights)]) for i in range(len(names))]
    targets = water_fill(sizes, of, share * sum(sizes), max_repeat)
    facts = spark.createDataFrame(
        [(n, i, s, t) for i, (n, s, t) in enumerate(zip(names, sizes, targets, strict=True))],
        "source string, at int, source_size long, target double",
    )
    placed = rows.join(facts, rows["source"].eqNullSafe(facts["source"])).drop("source")

    # texts of several sources, and the words of each pattern
    held = placed.groupBy("text_key", "at").agg(F.sum("size").alias("words"), F.max("size").alias("distinct"))
    pattern = F.array_join(F.array_sort(F.collect_set("at")).cast("array<string>"), ",")
    texts = held.groupBy("text_key").agg(pattern.alias("pattern"), F.max("distinct").alias("distinct")).where("instr(pattern, ',') > 0")
    shared = materialize(texts.select("text_key", "pattern", "distinct"), "patterns")
    placed = placed.join(shared.drop("distinct"), "text_key", "left").withColumn("pattern", F.coalesce("pattern", F.col("at").cast("string")))
    tagged = materialize(placed.drop("text_key"), "cells")
    alone = held.join(shared, "text_key", "left_anti").select(F.col("at").cast("string").alias("pattern"), "distinct")
    distinct = alone.union(shared.select("pattern", "distinct")).groupBy("pattern").agg(F.sum("distinct").alias("distinct"))
    cells = tagged.groupBy("pattern", "at").agg(F.sum("size").alias("words")).join(distinct, "pattern").where("words > 0").toArrow()

    encoded = cells["pattern"].combine_chunks().dictionary_encode()
    by_name = pc.sort_indices(encoded.dictionary)
    rank = np.empty(len(by_name), np.int64)
    rank[by_name.to_numpy()] = np.arange(len(by_name))
    pattern, source = rank[encoded.indices.to_numpy()], cells["at"].to_numpy()
    order = np.lexsort((pattern, source))
    pattern, source, words = pattern[order], source[order], cells["words"].to_numpy()[order]
    once = np.zeros(len(rank), np.int64)
    once[pattern] = cells["distinct"].to_numpy()[order]
    flow = cell_flow(once, pattern, source, words * max_repeat, _whole(targets)) if names else words
    plan = pa.table(
        {
            "pattern": encoded.dictionary.take(by_name).take(pa.array(pattern)),
            "at": pa.array(source, pa.int32()),
            "passes": pa.array(flow // words, pa.int64()),
            "rest": pa.array(flow % words, pa.int64()),
        }
    )
    passes = spark.createDataFrame(plan)

    # the rest, in the order of a seeded hash
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 1)  # 63 bits
    n = tagged.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / RANGE_ROWS)))
    part = F.shiftright(order, 63 - bits) if bits else F.lit(0).cast("long")
    drawn = tagged.withColumn("order", order).withColumn("part", part)
    ranges = drawn.groupBy("pattern", "at", "part").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("pattern", "at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranges.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
        .join(passes, ["pattern", "at"])
        .withColumn("left", F.col("rest") - F.col("before"))  # words still to take when the range begins
    )
    drawn = drawn.join(ranges.drop("before", "rest"), ["pattern", "at", "part"], "left")
    kept = ["doc_id", "size", "source_size", "target", *extra]
    whole = drawn.where("left is null or left <= 0 or left >= words").select(
        *kept,
        (F.coalesce("passes", F.lit(0)) * F.col("size") + F.when(F.col("left") >= F.col("words"), F.col("size")).otherwise(0)).alias("taken"),
    )
    within = Window.partitionBy("pattern", "at", "part").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = drawn.where("left > 0 and left < words").withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    some = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("ahead")))
    partly = cut.select(*kept, (F.col("passes") * F.col("size") + some).alias("taken"))
    return whole.union(partly)
