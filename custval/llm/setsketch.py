"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct word shingles.  A register is a truncated
logarithm (base ``BASE``) of the smallest of exponentially distributed hashes
over the set, so registers merge by maximum and equal registers are as likely as
the sets are similar.  Steps, all as Spark jobs:

1. Sketch every document (one narrow pass): shingle count, registers, and a
   128-bit digest of the set.  Documents with equal sets form a class, the node
   of everything below; the classes are one partial aggregate, whatever a
   group's size.
2. Band the registers.  Nodes that share a band's registers meet in a bucket;
   buckets are dealt into chunks of bounded size, so none gathers in one task.
3. Estimate the similarity of nodes that meet jointly by maximum likelihood
   from the counts of larger, smaller and equal registers and the known set
   sizes.  Only pairs whose likelihood allows the threshold go on.
4. First round: each node's most similar earlier node of its chunk.  In buckets of
   several chunks, a node without a likely partner so far then meets the members of
   all chunks by registers alone, so that no node with a likely partner anywhere is
   left out of what follows.  Verify on the full sets, find components.  Second round: in every bucket that still holds several
   components, the members outside the largest one meet all members, chunk by
   chunk with their full sets, and every likely pair of different components is
   verified there until a link joins the two; only such links leave the task.
   Pairs inside a component need no test, so a large group of copies costs about
   one test per node, and no possible link between components goes untested.
5. Components of the verified links, spread to classes and documents.

The number of bands of ``ROWS`` registers follows from the threshold (:class:`Rule`): a pair at it fails to
meet in any band with probability 1e-5 at most (0.85: 16 bands, 8e-6; 0.8: 22 bands), and less above it.

Defined results: a document without words (null or empty text) has set size 0
and is its own component; with fewer words than a shingle the whole sequence is
one shingle; repeated rows share a class and are all returned; a null id takes
part but never names a component with other ids (``kept`` is then false); extra
columns are ignored; an empty table gives an empty result.  Shingles are compared
by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custval.llm.common import blocks, keyed, released, word_codes
from custval.llm.graph import components
from custval.session import materialize

#: What links two documents unless a caller says otherwise: words of a shingle, and PERCENT in
#: 100 * intersection >= PERCENT * union.
SHINGLE = 3
PERCENT = 85

#: Registers of a band, least number of bands, and how likely a pair at the threshold may fail to meet in any.
ROWS, LEAST_BANDS, MISSED = 4, 16, 1e-5
#: Base and rate of the exponential scale, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_535


@dataclass(frozen=True)
class Rule:
    """What makes two documents near, and the sketch that finds them: bands enough for pairs at the threshold to meet."""

    shingle: int = SHINGLE
    percent: int = PERCENT

    @cached_property
    def bands(self) -> int:
        apart = 1.0 - (self.percent / 100.0) ** ROWS
        return max(LEAST_BANDS, math.ceil(math.log(MISSED) / math.log(apart))) if apart > 0 else LEAST_BANDS

    @property
    def registers(self) -> int:
        return self.bands * ROWS

    @cached_property
    def constants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Multiplier and summand of every register's hash, and a factor for every place in a shingle."""
        rng = np.random.default_rng(20_240_607)
        multiply = rng.integers(0, 2**63, self.registers, np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**64, self.registers, np.uint64)
        return multiply, add, rng.integers(0, 2**63, self.shingle + 1, np.uint64) * np.uint64(2) + np.uint64(1)


RULE = Rule()
BANDS, REGISTERS = RULE.bands, RULE.registers

#: A pair is dropped before verification if the threshold is less likely than its best estimate by this log factor (4.2 sigma).
LOG_FACTOR = 9.0
#: Members of a bucket's chunk that meet in one step, and shingles of those whose full sets meet.
CHUNK = 1024
CHUNK_SHINGLES = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, rule: Rule = RULE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    size, place = rule.shingle, rule.constants[2]
    codes, offsets, words = word_codes(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in pc.cast(words, pa.binary()).to_pylist()), np.uint64, len(words))
    word = hashes[codes]
    n = len(word)
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        whole[: n - k] += mix(word[k:] + place[k]) * place[k]
    whole = mix(whole)
    sets = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - start >= size:
            sets.append(np.unique(whole[start : end - size + 1]))
        elif end > start:
            few = place[size:]
            for i in range(start, end):
                few = mix(few + word[i : i + 1])
            sets.append(few)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def registers(sets: list[np.ndarray], step: int = 1 << 15, rule: Rule = RULE) -> np.ndarray:
    """SetSketch registers, one row for each set (zeros for an empty one)."""
    multiply, add, _ = rule.constants
    out = np.zeros((len(sets), rule.registers), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, n = at, 0
        while end < len(full) and (end == at or n + len(sets[full[end]]) <= step):
            n += len(sets[full[end]])
            end += 1
        group = full[at:end]
        joined = np.concatenate([sets[i] for i in group])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in group])[:-1]])
        least = np.empty((len(group), rule.registers), np.uint64)
        for k in range(rule.registers):
            least[:, k] = np.minimum.reduceat(joined * multiply[k] + add[k], starts)
        uniform = (least.astype(np.float64) + 1.0) * 2.0**-64
        smallest = -np.log1p(-np.minimum(uniform, 1.0 - 2.0**-53)) / RATE
        out[group] = np.clip(np.floor(1.0 - np.log(smallest) / np.log(BASE)), 0, TOP).astype(np.uint16)
        at = end
    return out


def _share(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that one set's register is larger, given its excess share x; and the derivative."""
    c = (BASE - 1.0) / BASE
    x = np.maximum(x, 1e-12)
    return -np.log1p(-x * c) / np.log(BASE), c / (np.log(BASE) * (1.0 - x * c))


def joint_estimate(equal, larger, smaller, na, nb, rule: Rule = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood similarity of two sets of known sizes, and how far (log) the threshold falls below it."""
    u, v = na / (na + nb), nb / (na + nb)
    high = np.minimum(u / v, v / u)

    def parts(j):
        p, dp = _share(u - v * j)
        q, dq = _share(v - u * j)
        return p, dp, q, dq, np.maximum(1.0 - p - q, 1e-12)

    def log_likelihood(j):
        p, _, q, _, same = parts(j)
        return larger * np.log(p) + smaller * np.log(q) + equal * np.log(same)

    lo, hi = np.zeros(len(u)), high.copy()
    for _ in range(30):
        j = (lo + hi) / 2
        p, dp, q, dq, same = parts(j)
        slope = equal * (v * dp + u * dq) / same - larger * v * dp / p - smaller * u * dq / q
        up = slope > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    best = (lo + hi) / 2
    at = np.minimum(rule.percent / 100.0, high)
    gap = np.where(best >= at, 0.0, log_likelihood(best) - log_likelihood(at))
    return best, gap


def likely(regs: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, rule: Rule = RULE, step: int = 1 << 16):
    """Of the index pairs (a, b), those that may reach the threshold: (a, b, estimate)."""
    found = []
    fits = 100 * np.minimum(size[a], size[b]) >= rule.percent * np.maximum(size[a], size[b])
    a, b = a[fits], b[fits]
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        rx, ry = regs[x], regs[y]
        equal = np.count_nonzero(rx == ry, axis=1)
        near = equal >= rule.registers // 2
        x, y, rx, ry, equal = x[near], y[near], rx[near], ry[near], equal[near]
        larger = np.count_nonzero(rx > ry, axis=1)
        estimate, gap = joint_estimate(equal, larger, rule.registers - equal - larger, size[x].astype(float), size[y].astype(float), rule)
        ok = gap <= LOG_FACTOR
        found.append((x[ok], y[ok], estimate[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _sketch(batches: Iterator[pa.RecordBatch], rule: Rule = RULE) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        sets = shingle_sets(block.column("text"), rule)
        regs = registers(sets, rule=rule)
        digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.record_batch(
            [
                block.column("doc_id"),
                block.column("tag"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digest, pa.binary()),
                pa.array([r.tobytes() if d else None for r, d in zip(regs, digest, strict=True)], pa.binary()),
            ],
            names=["doc_id", "tag", "n_shingles", "node", "regs"],
        )


def _sets(batches: Iterator[pa.RecordBatch], rule: Rule = RULE) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        sets = [s for s in shingle_sets(block.column("text"), rule) if len(s)]
        yield pa.record_batch(
            [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["node", "shingles"],
        )


def _members(column: pa.Array, rule: Rule):
    """A list column of (node, n_shingles, regs, ...) structs: offsets, nodes, sizes, registers, the struct array."""
    flat = column.flatten()
    offsets = column.offsets.to_numpy().astype(np.int64)
    regs = np.frombuffer(b"".join(flat.field("regs").to_pylist()), np.uint16).reshape(-1, rule.registers)
    return offsets - offsets[0], flat.field("node"), flat.field("n_shingles").to_numpy(zero_copy_only=False), regs, flat


def _pairs_in(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.triu_indices(hi - lo, 1)
    return a + lo, b + lo


def _grouped(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each group, a bounded number at a time."""
    xs, ys, n = [], [], 0
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        a, b = (np.array([lo]), np.array([lo + 1])) if hi - lo == 2 else _pairs_in(lo, hi)
        xs.append(a)
        ys.append(b)
        n += len(a)
        if n >= most:
            yield np.concatenate(xs), np.concatenate(ys)
            xs, ys, n = [], [], 0
    if xs:
        yield np.concatenate(xs), np.concatenate(ys)


def _nearest(batches: Iterator[pa.RecordBatch], rule: Rule = RULE) -> Iterator[pa.RecordBatch]:
    """Each member's most similar earlier member of its chunk (null if all likely ones come later)."""
    for batch in batches:
        offsets, nodes, size, regs, _ = _members(batch.column("members"), rule)
        order = np.argsort(np.argsort(np.array(nodes.to_pylist(), dtype="S16"), kind="stable"), kind="stable")
        best = np.full(len(size), -1, np.int64)
        value = np.full(len(size), -1.0)
        for a, b in _grouped(offsets):
            x, y, estimate = likely(regs, size, a, b, rule)
            later, earlier = np.where(order[x] > order[y], x, y), np.where(order[x] > order[y], y, x)
            np.maximum.at(value, earlier, 0.0)
            by = np.lexsort((estimate, later))
            later, earlier, estimate = later[by], earlier[by], estimate[by]
            last = np.append(np.flatnonzero(np.diff(later)), len(later) - 1) if len(later) else np.zeros(0, np.int64)
            better = last[estimate[last] > value[later[last]]]
            value[later[better]], best[later[better]] = estimate[better], earlier[better]
        some = np.flatnonzero(value >= 0)
        to = pa.array(np.where(best[some] >= 0, best[some], 0), mask=best[some] < 0)
        yield pa.record_batch([nodes.take(pa.array(some)), nodes.take(to), pa.array(value[some])], names=["a", "b", "estimate"])


def _meeting(batches: Iterator[pa.RecordBatch], rule: Rule = RULE) -> Iterator[pa.RecordBatch]:
    """Nodes of likely pairs between a chunk of a bucket's lonely members and a chunk of all its members."""
    for batch in batches:
        offsets, nodes, size, regs, flat = _members(batch.column("members"), rule)
        node = nodes.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        lonely = flat.field("lonely").to_numpy(zero_copy_only=False).astype(bool)
        found = np.zeros(len(size), bool)
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            some, every = lo + np.flatnonzero(lonely[lo:hi]), lo + np.flatnonzero(~lonely[lo:hi])
            for part in np.array_split(some, max(1, len(some) * len(every) >> 18)):
                a, b = np.repeat(part, len(every)), np.tile(every, len(part))
                other = node[a] != node[b]
                x, y, _ = likely(regs, size, a[other], b[other], rule)
                found[x] = found[y] = True
        yield pa.record_batch([nodes.filter(pa.array(found))], names=["node"])


def _same(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _across(batches: Iterator[pa.RecordBatch], rule: Rule = RULE) -> Iterator[pa.RecordBatch]:
    """Links between components, from a chunk of a bucket's smaller components and a chunk of all its members.

    Likely pairs are verified on the spot, the most similar first, unless an earlier
    link has joined their components.  A pair is looked at in its first common band only.
    """
    for batch in batches:
        offsets, nodes, size, regs, flat = _members(batch.column("members"), rule)
        keys = regs.view(f"V{2 * ROWS}").reshape(len(regs), rule.bands)
        band = batch.column("band").to_pylist()
        comp = flat.field("component").dictionary_encode().indices.to_pylist()
        node = nodes.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sets = flat.field("shingles")
        side = flat.field("rest").to_numpy(zero_copy_only=False).astype(bool)
        labels = np.array(comp)
        links: list[tuple[int, int]] = []
        for g, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            rest, every = lo + np.flatnonzero(side[lo:hi]), lo + np.flatnonzero(~side[lo:hi])
            into: dict[int, int] = {}

            def root(c: int, into=into) -> int:
                while c in into:
                    c = into[c]
                return c

            found = []
            for part in np.array_split(rest, max(1, len(rest) * len(every) >> 18)):
                a, b = np.repeat(part, len(every)), np.tile(every, len(part))
                other = (labels[a] != labels[b]) & (node[a] != node[b])
                x, y, estimate = likely(regs, size, a[other], b[other], rule)
                fresh = (
                    np.ones(len(x), bool)
                    if not band[g] or not len(x)
                    else ~np.any(keys[x, : band[g]] == keys[y, : band[g]], axis=1)
                )
                found.append((x[fresh], y[fresh], estimate[fresh]))
            x, y, estimate = (np.concatenate(c) for c in zip(*found, strict=True))
            opened: dict[int, np.ndarray] = {}
            for k in np.argsort(-estimate, kind="stable").tolist():
                i, j = int(x[k]), int(y[k])
                p, q = root(comp[i]), root(comp[j])
                if p != q:
                    for m in (i, j):
                        if m not in opened:
                            opened[m] = np.frombuffer(sets[m].as_buffer(), np.uint64)
                    if _same(opened[i], opened[j], rule.percent):
                        into[p] = q
                        links.append((i, j))
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        yield pa.record_batch([nodes.take(pa.array(u)), nodes.take(pa.array(v))], names=["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch], rule: Rule = RULE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("x"), batch.column("y"), strict=True)
        keep = [_same(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), rule.percent) for x, y in pairs]
        linked = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.record_batch([linked.column("a"), linked.column("b")], names=["u", "v"])


def _parts(n: Column, shingles: Column) -> Column:
    """Chunks for so many members with so many shingles in all."""
    return F.greatest(F.ceil(n / CHUNK), F.ceil(shingles / CHUNK_SHINGLES), F.lit(1)).cast("long")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as links (u, v)."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(released(partial(_verify, rule=rule)), "u binary, v binary")


def setsketch_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tag: Column | None = None,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents link if their sets of ``shingle`` words are ``percent`` / 100 similar or more.
    With ``tag``, an integer column of ``docs`` that comes back with each row.
    """
    if shingle < 1 or not 70 <= percent <= 100:
        raise ValueError("a shingle has a word at least, and the threshold is between 70 and 100 percent")
    rule = Rule(shingle, percent)
    rows = keyed(docs, doc_id=id_col, text=text_col, tag=(F.lit(None) if tag is None else tag).cast("long"))
    sketched = materialize(
        rows.mapInArrow(released(partial(_sketch, rule=rule)), "doc_id long, tag long, n_shingles long, node binary, regs binary"), "sketches"
    )
    nodes = materialize(
        sketched.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")),
        "nodes",
    )

    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + i * width, width)) for i in range(rule.bands)])
    banded = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(crowded, "key").select("key", "band", "n", "node"), "members")
    facts = nodes.select("node", "n_shingles", "regs")

    chunk = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / CHUNK))
    chunks = (
        members.join(facts, "node")
        .groupBy("key", chunk.alias("chunk"))
        .agg(F.collect_list(F.struct("node", "n_shingles", "regs")).alias("members"))
        .where(F.size("members") > 1)
    )
    nearest = materialize(
        chunks.select("members")
        .mapInArrow(released(partial(_nearest, rule=rule)), "a binary, b binary, estimate double")
        .groupBy("a")
        .agg(F.max_by("b", F.when(F.col("b").isNotNull(), F.struct("estimate", "b"))).alias("b")),
        "nearest",
    )

    near = nearest.select(F.col("a").alias("node"))
    crowd = members.where(F.col("n") > CHUNK).join(facts, "node")
    lone = crowd.join(near, "node", "left_anti")
    lone_keys = lone.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("lone_parts"))
    spread = crowd.join(lone_keys, "key").withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("long"))
    some = lone.join(lone_keys, "key").select(
        "key",
        F.pmod(F.xxhash64("node"), "lone_parts").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / CHUNK).cast("long") - 1)).alias("j"),
        F.struct("node", "n_shingles", "regs", F.lit(True).alias("lonely")).alias("member"),
    )
    all_of = spread.select(
        "key",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("lone_parts") - 1)).alias("i"),
        F.pmod(F.xxhash64("node"), "parts").alias("j"),
        F.struct("node", "n_shingles", "regs", F.lit(False).alias("lonely")).alias("member"),
    )
    meetings = some.union(all_of).groupBy("key", "i", "j").agg(F.collect_list("member").alias("members"))
    late = meetings.select("members").mapInArrow(released(partial(_meeting, rule=rule)), "node binary")
    near = materialize(near.union(late).distinct(), "near")

    wanted = nodes.join(near, "node", "left_semi").select(F.col("first_id").alias("doc_id"))
    wanted_rows = rows.join(wanted.distinct(), rows["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    read = wanted_rows.mapInArrow(released(partial(_sets, rule=rule)), "node binary, shingles binary")
    sets = materialize(read.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    first = nearest.where("b is not null").select("a", "b")
    links = materialize(verified(first, sets, rule), "verified")

    joined = components(links)
    open_members = (
        members.join(sets.select("node", (F.length("shingles") / 8).alias("size")), "node")
        .join(joined, "node", "left")
        .select("key", "band", "node", "size", F.coalesce("component", "node").alias("component"))
    )
    counted = open_members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    open_keys = (
        counted.groupBy("key")
        .agg(
            F.max_by(F.struct("component", "n", "size"), F.struct("n", "component")).alias("main"),
            F.sum("n").alias("n"),
            F.sum("size").alias("size"),
        )
        .where("main.n < n")
        .select("key", "main.component", _parts(F.col("n"), F.col("size")).alias("parts"), _parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("rest_parts"))
        .withColumnRenamed("component", "main")
    )
    fields = ["node", "n_shingles", "regs", "component", "shingles"]
    placed = open_members.join(open_keys, "key").join(facts, "node").join(sets, "node")
    rest = placed.where("component <> main").select(
        "key",
        "band",
        F.pmod(F.xxhash64("node"), "rest_parts").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"),
        F.struct(*fields, F.lit(True).alias("rest")).alias("member"),
    )
    every = placed.select(
        "key",
        "band",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_parts") - 1)).alias("i"),
        F.pmod(F.xxhash64("node"), "parts").alias("j"),
        F.struct(*fields, F.lit(False).alias("rest")).alias("member"),
    )
    blocks_of = rest.union(every).groupBy("key", "band", "i", "j").agg(F.collect_list("member").alias("members"))
    more = materialize(blocks_of.select("band", "members").mapInArrow(released(partial(_across, rule=rule)), "u binary, v binary"), "verified")

    final = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    named = nodes.select("node", "first_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = named.join(smallest, "component").select("node", "component_id")
    own = ["doc_id", "n_shingles", *(["tag"] if tag is not None else [])]
    full = sketched.where("node is not null").select(*own, "node").join(of_node, "node")
    alone = sketched.where("node is null").select(*own, F.col("doc_id").alias("component_id"))
    both = full.select(*own, "component_id").union(alone)
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
