"""Sharding by a k-d tree over document metadata, in DataFrame functions only.

The points of the tree are texts (all copies of a text are one point, so they share a
shard) with the bytes of their documents as weight.  A node that is to hold several
leaves is split along its widest dimension (relative to the whole table) at the
weighted median, until every leaf has its share of the bytes.

The medians of all nodes of a level are found together by narrowing: one aggregate
adds the bytes of ``BINS`` equal ranges of each node's values, the range with the
median is cut again, down to one value; equal values go by the text's hash, and
points larger than ``SPLIT`` of a leaf are dealt into pieces by document hash
beforehand, so that a third of all rows in one text does not unbalance the shards.
The driver sees a row per node and range, never a document.

Slots number a shard's documents in the order of a hash; ranges of the hash are
numbered apart and offset by the counts of the earlier ones, so no task holds a shard.

Defined results: a null text counts as empty (its size is 1); null metadata comes
first; repeated rows (equal id and text) share a shard and get slots of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custval.llm.common import keyed
from custval.operators.order_stats import global_rank
from custval.session import materialize

#: Ranges that one pass of the search tells apart in each node.
BINS = 1024
#: Share of a leaf: groups of copies above it are placed before the tree; a cut closer than a tenth of it is good enough.
SPLIT = 0.005
#: Documents of a hash range that are numbered together.
RANGE_ROWS = 4096


def value_ranks(docs: DataFrame, column: str) -> DataFrame:
    """value, rank: the distinct values of a text column, numbered in the order of their bytes (whole values, no prefix)."""
    values = docs.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return materialize(global_rank(values, ["value"], "rank"), "values")  # its size is known then: joined by broadcast if small


def place_groups(sizes: list[tuple[int, int]], shards: int, leaf: float) -> tuple[dict[int, int], list[float]]:
    """Shard of each group of copies (hash, bytes) that fits whole, and what every shard has left then.

    The largest first, each into the shard with the most room; a group beyond the room of every shard gets none.
    """
    room = [leaf] * shards
    placed = {}
    for key, size in sorted(sizes, key=lambda g: (-g[1], g[0])):
        best = max(range(shards), key=lambda s: room[s])
        if size <= room[best]:
            placed[key] = best
            room[best] -= size
    return placed, room


def _case(values: dict[int, Column], of: Column) -> Column:
    out = F.lit(None).cast("long")
    for node, value in values.items():
        out = F.when(of == node, value).otherwise(out)
    return out


class _Cut:
    """The search for one node's cut: keys (value, hash, piece) in turn, narrowed to [low, high]."""

    def __init__(self, half: float, near: float):
        self.half, self.near = half, near
        self.stage = 0
        self.prefix: list[int] = []  # keys fixed by the finished stages
        self.low = self.high = 0
        self.before = 0  # bytes below the open range
        self.bound: tuple[list[int], int] | None = None  # cut: keys up to and including (prefix, last)
        self.fresh = True

    @property
    def width(self) -> int:
        return (self.high - self.low) // BINS + 1

    def narrow(self, bins: list[tuple[int, int, int, int]], last_stage: int) -> None:
        """bins: (number, bytes, least key, largest key), in order.  Settle the cut or the next range."""
        total, below = self.before, None
        for _, size, least, most in bins:
            if total + size >= self.half or (least, most) == bins[-1][2:]:
                short, over = self.half - total, total + size - self.half
                if min(short, over) <= self.near or (least == most and self.stage == last_stage):
                    if short < over:  # the cut is nearer before this range
                        self.bound = (self.prefix, below if below is not None else self.low - 1)
                    else:
                        self.bound = (self.prefix, most)
                elif least == most:
                    self.prefix, self.stage, self.before, self.fresh = [*self.prefix, least], self.stage + 1, total, True
                else:
                    self.low, self.high, self.before = least, most, total
                return
            total, below = total + size, most


def _cuts(points: DataFrame, keys: dict[int, Column], shares: dict[int, tuple[float, float]]) -> dict[int, tuple[list[int], int]]:
    """For every node the last keys of its left side: weighted medians, all nodes of a level at once."""
    order = [_case(keys, F.col("node")), F.col("hash"), F.col("piece").cast("long")]
    found = {node: _Cut(half, near) for node, (half, near) in shares.items()}
    while True:
        todo = {node: cut for node, cut in found.items() if cut.bound is None}
        if not todo:
            return {node: cut.bound for node, cut in found.items()}
        inside, key = F.lit(False), F.lit(None).cast("long")
        low, width = {}, {}
        for node, cut in todo.items():
            fixed = F.col("node") == node
            for k, value in enumerate(cut.prefix):
                fixed = fixed & (order[k] == value)
            if not cut.fresh:
                fixed = fixed & order[cut.stage].between(cut.low, cut.high)
            inside = inside | fixed
            key = F.when(F.col("node") == node, order[cut.stage]).otherwise(key)
            low[node], width[node] = F.lit(cut.low), F.lit(cut.width)
        fresh = [node for node, cut in todo.items() if cut.fresh]
        open_ = points.where(inside).withColumn("key", key)
        if fresh:  # a new stage begins with its range
            for r in open_.where(F.col("node").isin(fresh)).groupBy("node").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect():
                found[r.node].low, found[r.node].high, found[r.node].fresh = r.a, r.b, False
                low[r.node], width[r.node] = F.lit(r.a), F.lit(found[r.node].width)
        # (key - low) in decimals: the range of a hash exceeds a long
        offset = F.col("key").cast("decimal(20,0)") - _wide(low)
        number = F.floor(offset / _wide(width)).cast("long")
        rows = (
            open_.groupBy("node", number.alias("bin"))
            .agg(F.sum("bytes").alias("bytes"), F.min("key").alias("a"), F.max("key").alias("b"))
            .orderBy("node", "bin")
            .collect()  # at most BINS rows for each node
        )
        for node, cut in todo.items():
            cut.narrow([(r.bin, r.bytes, r.a, r.b) for r in rows if r.node == node], len(order) - 1)


def _wide(values: dict[int, Column]) -> Column:
    out = F.lit(None).cast("decimal(20,0)")
    for node, value in values.items():
        out = F.when(F.col("node") == node, value.cast("decimal(20,0)")).otherwise(out)
    return out


def kd_shards(
    docs: DataFrame,
    shards: int | None = 16,
    target_bytes: int | None = None,
    dimensions: Sequence[Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    ``shards`` leaves, or as many as reach ``target_bytes``.  ``dimensions`` are integer
    columns of ``docs`` (default: the text's length, and the ranks of source and language among
    their values); a text takes the least value over its copies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = ["source", "lang"] if dimensions is None else []
    dimensions = [F.length(text)] if dimensions is None else dimensions
    columns = {f"dim_{i}": F.coalesce(c.cast("long"), F.lit(-1).cast("long")) for i, c in enumerate(dimensions)}
    values = {f"value_{i}": F.col(column).cast("string") for i, column in enumerate(named, len(columns))}
    body = text.cast("binary")
    size = (F.octet_length(text) + 1).cast("long")
    # narrow rows from here on: no text is shuffled
    rows = keyed(docs, doc_id=id_col, size=size, text_crc32=F.crc32(body).cast("long"), hash=F.xxhash64(text), **columns, **values)
    for i, column in enumerate(named, len(columns)):
        ranks = value_ranks(docs, column).select(F.col("value").alias(f"value_{i}"), F.col("rank").cast("long").alias(f"dim_{i}"))
        rows = rows.join(ranks, f"value_{i}", "left").fillna(-1, f"dim_{i}")
    dims = [f"dim_{i}" for i in range(len(columns) + len(named))]
    rows = materialize(rows.select("doc_id", "size", "text_crc32", "hash", *dims), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = shards if shards else max(1, -(-total // target_bytes))
    leaf = total / leaves

    texts = rows.groupBy("hash").agg(F.sum("size").alias("text_bytes"), F.count("*").alias("copies"), *[F.min(d).alias(d) for d in dims])
    # groups of copies that would unbalance a cut: at most leaves / SPLIT of them
    large = [(r.hash, r.text_bytes) for r in texts.where((F.col("text_bytes") > SPLIT * leaf) & (F.col("copies") > 1)).select("hash", "text_bytes").collect()]
    whole_groups, room = place_groups(large, leaves, leaf)
    of_group = [(key, whole_groups.get(key), None if key in whole_groups else math.ceil(size / max(SPLIT * leaf, 1.0))) for key, size in large]
    split = rows.sparkSession.createDataFrame(of_group, "hash long, fixed int, pieces int")
    rows = rows.join(F.broadcast(split), "hash", "left").withColumn(
        "piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), "pieces")).cast("int")
    )
    points = materialize(
        rows.where("fixed is null")
        .groupBy("hash", "piece")
        .agg(F.sum("size").alias("bytes"))
        .join(texts.drop("text_bytes", "copies"), "hash")
        .withColumn("node", F.lit(0)),
        "points",
    )

    span = points.agg(*[F.min(d) for d in dims], *[F.max(d) for d in dims]).first()
    whole = [(span[i + len(dims)] or 0) - (span[i] or 0) for i in range(len(dims))]
    nodes = {0: leaves} if n else {}
    while any(k > 1 for k in nodes.values()):
        stats = points.groupBy("node").agg(
            F.sum("bytes").alias("bytes"), *[F.min(d).alias(f"a{d}") for d in dims], *[F.max(d).alias(f"b{d}") for d in dims]
        )
        keys, shares = {}, {}
        for r in stats.collect():  # one row per node
            k = nodes[r.node]
            if k > 1:
                wide = [(r[f"b{d}"] - r[f"a{d}"]) / w if w else 0.0 for d, w in zip(dims, whole, strict=True)]
                keys[r.node] = F.col(dims[wide.index(max(wide))])
                left, both = sum(room[r.node : r.node + k // 2]), sum(room[r.node : r.node + k])
                shares[r.node] = (r.bytes * (left / both if both > 0 else k // 2 / k), SPLIT * leaf / 10)
        side = F.lit(0)
        for node, (prefix, last) in _cuts(points, keys, shares).items():
            order = [keys[node], F.col("hash"), F.col("piece").cast("long")]
            left = order[len(prefix)] <= last
            for k in range(len(prefix) - 1, -1, -1):
                left = (order[k] < prefix[k]) | ((order[k] == prefix[k]) & left)
            side = F.when((F.col("node") == node) & ~left, nodes[node] // 2).otherwise(side)
        points = materialize(points.withColumn("node", F.col("node") + side), "points")
        nodes = {first: k for node, count in nodes.items() for first, k in _halves(node, count)}

    of_tree = rows.where("fixed is null").join(points.select("hash", "piece", F.col("node").alias("shard")), ["hash", "piece"])
    columns = ["doc_id", "size", "text_crc32", "hash", "shard"]
    placed = of_tree.select(*columns).union(rows.where("fixed is not null").withColumn("shard", F.col("fixed")).select(*columns))
    order = F.shiftrightunsigned(F.xxhash64("doc_id", "hash"), 1)  # 63 bits
    bits = max(0, math.ceil(math.log2(max(1, n) / leaves / RANGE_ROWS)))
    part = F.shiftright(order, 63 - bits) if bits else F.lit(0).cast("long")
    placed = placed.select("doc_id", "size", "text_crc32", "shard", order.alias("order"), part.alias("part"))
    so_far = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("order", "doc_id", "text_crc32")
    numbered = placed.withColumn("rank", F.row_number().over(within)).join(counts, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))


def _halves(first: int, count: int) -> list[tuple[int, int]]:
    return [(first, count // 2), (first + count // 2, count - count // 2)] if count > 1 else [(first, count)]
