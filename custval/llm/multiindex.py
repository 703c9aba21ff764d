"""Near-duplicate embeddings through an inverted multi-index.

Vectors are scaled to length 1 and cut in halves.  Each half has a codebook of its own
(k-means on a bounded sample); the pairs of codewords are the cells of a product grid,
and a vector is stored in the cell of its halves' nearest codewords.

A search visits the cells of the grid from the nearest outwards.  The distance of a
half from the region of another codeword is at least its distance from the plane
between that codeword and its own one, and the squares of both halves' distances add
up.  The traversal stops where this bound passes the radius that the threshold
leaves (|x - y|**2 = 2 - 2 cos), so its target recall is 1: no cell that could hold
a link is left out, whatever the codebooks.  Visited cells are verified in double precision.
``traverse`` lists the cells of one search in order.

On Spark, the first half's codeword is the partition: a vector is sent to the
codewords at or after its own that the bound allows, and there all searches of a block
go through the grid's cells in step, each from its nearest outwards until its bound stops it
(``nearest_first``).  Members and visitors of a codeword are dealt into chunks of
bounded size that meet block by block, so no group gathers in one task.  A block
emits a degree and a link or two per vector, never its pairs.

Equal vectors of a label are one node with a count, so copies cost nothing.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and vectors without a label, link with nothing (component: their own id); vectors of different lengths
do not link; repeated rows are vectors of their own; a null id never names a
component with other ids (``kept`` is then false); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custval.llm.common import keyed, released
from custval.llm.graph import components
from custval.session import materialize

THRESHOLD = 0.98
#: Codewords of each half, vectors of the sample they are fitted on (those of smallest hash), rounds of the fit.
CODEWORDS = 64
SAMPLE = 8192
ROUNDS = 12
#: Members and visitors of a codeword that meet in one block.
CHUNK = 1024

Codebooks = dict[int, tuple[np.ndarray, np.ndarray]]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision, scaled to length 1 (their largest component first, so that nothing overflows)."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def codebook(points: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly spaced points of the sample; empty codewords stay where they were."""
    distinct = np.unique(points, axis=0)
    words = distinct[np.linspace(0, len(distinct) - 1, min(count, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        nearest = squared_distances(points, words).argmin(axis=1)
        total = np.zeros_like(words)
        np.add.at(total, nearest, points)
        n = np.bincount(nearest, minlength=len(words))
        words[n > 0] = total[n > 0] / n[n > 0, None]
    return words


def squared_distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ words.T + (words**2).sum(axis=1), 0.0)


def bounds(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each point, and the least squared distance of each point from every codeword's region."""
    d = squared_distances(points, words)
    own = d.argmin(axis=1)
    apart = np.sqrt(squared_distances(words, words))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d - d[np.arange(len(d)), own][:, None]) / (2 * apart)
    plane = np.where(apart > 1e-9, np.maximum(plane - 1e-7, 0.0), 0.0)  # rounding only ever widens the search
    plane[np.arange(len(d)), own] = 0.0
    return own, plane**2


def traverse(first: np.ndarray, second: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Cells (i, j) from the nearest outwards while the sum of the halves' bounds is within the squared radius."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    out, queue, seen = [], [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while queue:
        bound, i, j = heapq.heappop(queue)
        if bound > radius:
            break
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(queue, (first[a[x]] + second[b[y]], x, y))
    return out


def nearest_first(first: np.ndarray, second: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, int]]:
    """The traversal of many searches in step, within one codeword of the first half: (searches, cell) of every step.

    Each search goes to its next nearest cell, and ends at the first whose bound passes the squared radius.
    """
    order = np.argsort(second, axis=1, kind="stable")
    live = np.arange(len(first))
    for step in range(second.shape[1]):
        cell = order[live, step]
        within = first[live] + second[live, cell] <= radius
        live, cell = live[within], cell[within]
        if not len(live):
            return
        by_cell = np.argsort(cell, kind="stable")
        for some in np.split(by_cell, np.flatnonzero(np.diff(cell[by_cell])) + 1):
            yield live[some], int(cell[some[0]])


def fit_codebooks(sample: list[np.ndarray]) -> Codebooks:
    """Two codebooks for each vector length in the sample."""
    by_length: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for length, vectors in by_length.items():
        points = unit(np.stack(vectors))
        out[length] = (codebook(points[:, : length // 2], CODEWORDS), codebook(points[:, length // 2 :], CODEWORDS))
    return out


def _books(books: Codebooks, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A length that the sample missed has a grid of one cell."""
    return books.get(length) or (np.zeros((1, length // 2)), np.zeros((1, length - length // 2)))


def _prepare(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, nodes = [], []
            for v, label in zip(batch.column("vector"), batch.column("label").to_pylist(), strict=True):
                items = v.values if v.is_valid and label is not None else None
                good = items is not None and len(items) and not items.null_count
                x = items.to_numpy(zero_copy_only=False).astype(kind) if good else None
                good = good and bool(np.isfinite(x).all()) and bool(x.any())
                data.append(x.tobytes() if good else None)
                nodes.append(xxhash.xxh3_128_digest(str(label).encode() + b":" + data[-1]) if good else None)
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("label"), pa.array(nodes, pa.binary()), pa.array(data, pa.binary())],
                names=["vec_id", "label", "node", "vector"],
            )

    return run


def _visits(kind: type, books: Codebooks, radius: float):
    """Each vector's codeword of the first half, and the ones at or after it that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.frombuffer(v, kind) for v in batch.column("vector").to_pylist()]
            own: list[int] = [0] * len(vectors)
            visits: list[list[int]] = [[]] * len(vectors)
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                nearest, bound = bounds(unit(np.stack([vectors[i] for i in at]))[:, : length // 2], _books(books, length)[0])
                for i, code, row in zip(at.tolist(), nearest.tolist(), bound <= radius, strict=True):
                    own[i], visits[i] = code, (code + np.flatnonzero(row[code:])).tolist()
            columns = [batch.column(c) for c in ("node", "label", "copies", "vector")]
            columns += [pa.array(lengths, pa.int32()), pa.array(own, pa.int32()), pa.array(visits, pa.list_(pa.int32()))]
            yield pa.record_batch(columns, names=["node", "label", "copies", "vector", "length", "own", "visits"])

    return run


def _meet(kind: type, books: Codebooks, threshold: float, radius: float):
    """Degrees (node, null, number of vectors) and links (node, node, 0) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, ns = [], [], []
            lists = batch.column("rows")
            flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            node, copies = flat.field("node").to_pylist(), flat.field("copies").to_numpy()
            own, member = flat.field("own").to_numpy(), flat.field("member").to_numpy(zero_copy_only=False)
            vector = flat.field("vector").to_pylist()
            length, code = batch.column("length").to_pylist(), batch.column("code").to_pylist()
            for g, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                rows = np.arange(lo, hi)
                m, v = rows[member[lo:hi]], rows[~member[lo:hi]]
                if not len(m) or not len(v):
                    continue
                degree, joined = _block(kind, _books(books, length[g]), threshold, radius, code[g], m, v, vector, node, own, copies)
                us += [node[i] for i in degree] + [node[i] for i, _ in joined]
                vs += [None] * len(degree) + [node[j] for _, j in joined]
                ns += [*degree.values(), *[0] * len(joined)]
            yield pa.record_batch([pa.array(us, pa.binary()), pa.array(vs, pa.binary()), pa.array(ns, pa.int64())], names=["u", "v", "n"])

    return run


def _block(kind, books, threshold, radius, code, members, visitors, vector, node, own, copies):
    """Degrees and a spanning set of links of members and visitors of one codeword."""
    x = unit(np.stack([np.frombuffer(vector[i], kind) for i in members]))
    y = unit(np.stack([np.frombuffer(vector[i], kind) for i in visitors]))
    half = x.shape[1] // 2
    first = bounds(y[:, :half], books[0])[1][:, code]
    second = bounds(y[:, half:], books[1])[1]
    cell = bounds(x[:, half:], books[1])[0]
    label = {}  # union-find over rows
    degree: dict[int, int] = {}
    joined: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while label.get(i, i) != i:
            label[i] = label.get(label[i], label[i])
            i = label[i]
        return i

    held = {j: np.flatnonzero(cell == j) for j in np.unique(cell).tolist()}
    for near, j in nearest_first(first, second, radius):
        of = held.get(j)
        if of is None:
            continue
        a, b = np.nonzero(y[near] @ x[of].T >= threshold)
        a, b = visitors[near[a]], members[of[b]]
        # pairs of the codeword's own vectors come from both sides: count them once
        once = np.array([own[p] != code or node[p] < node[q] for p, q in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = a[once], b[once]
        for p, q in ((a, b), (b, a)):
            at, inverse = np.unique(p, return_inverse=True)
            for i, n in zip(at.tolist(), np.bincount(inverse, copies[q], len(at)).astype(int).tolist(), strict=True):
                degree[i] = degree.get(i, 0) + n
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            r, s = root(p), root(q)
            if r != s:
                label[r] = s
                joined.append((p, q))
    return degree, joined


def similar_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable by links), kept."""
    kind = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64
    element = "float" if kind is np.float32 else "double"
    radius = 2.0 - 2.0 * threshold + 1e-9
    rows = keyed(vectors, vec_id=id_col, vector=F.col(vector_col).cast(f"array<{element}>"), label=F.col(label_col).cast("string"))
    known = materialize(rows.mapInArrow(released(_prepare(kind)), "vec_id long, label string, node binary, vector binary"), "vectors")
    nodes = materialize(
        known.where("node is not null")
        .groupBy("node")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")),
        "nodes",
    )
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").collect()
    books = fit_codebooks([np.frombuffer(r.vector, kind) for r in sample])

    schema = "node binary, label string, copies long, vector binary, length int, own int, visits array<int>"
    placed = materialize(nodes.select("node", "label", "copies", "vector").mapInArrow(released(_visits(kind, books, radius)), schema), "placed")
    place = ["label", "length", "code"]
    sent = placed.withColumn("code", F.explode("visits"))
    stored = placed.withColumn("code", F.col("own"))
    visitors = sent.groupBy(*place).agg(F.ceil(F.count("*") / CHUNK).alias("v_parts"))
    parts = stored.groupBy(*place).agg(F.ceil(F.count("*") / CHUNK).alias("m_parts")).join(visitors, place)
    row = lambda member: F.struct("node", "copies", "vector", "own", F.lit(member).alias("member")).alias("row")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    blocks = (
        stored.join(parts, place)
        .select(*place, part("m_parts").alias("m"), every("v_parts").alias("v"), row(True))
        .union(sent.join(parts, place).select(*place, every("m_parts").alias("m"), part("v_parts").alias("v"), row(False)))
        .groupBy(*place, "m", "v")
        .agg(F.collect_list("row").alias("rows"))
    )
    found = materialize(
        blocks.select("length", "code", "rows").mapInArrow(released(_meet(kind, books, threshold, radius)), "u binary, v binary, n long"), "links"
    )

    degree = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("degree"))
    joined = components(found.where("v is not null").select("u", "v"))
    named = (
        nodes.select("node", "first_id", "copies")
        .join(degree, "node", "left")
        .join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = named.join(least, "component").select(
        "node", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = known.where("node is not null").select("vec_id", "node").join(of_node, "node").select("vec_id", "n_links", "component_id")
    alone = known.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
