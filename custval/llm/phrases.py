"""Collocations from depth-truncated suffix trees, partitioned vertically.

The suffixes of all pieces of text, cut after three words, are counted in trees that are
built group by group, in the way of ERA (Mansour et al. 2011):

1. words are counted, and with them the suffixes below each first word;
2. vertical partitioning: a prefix of one word that has more suffixes than a share of the memory
   budget is extended by the next word, and again if that word has too many as well; prefixes
   are dealt into so many groups that each stays within the budget;
3. every task turns its texts, block by block, into truncated subtrees (sorted leaves with counts) and
   sends each group its part; a group's task puts the parts together, and reads the counts of
   inner nodes (two words) and leaves (three) from the leaf totals below them.

A suffix ends before a word that is too rare for a candidate: a bit filter of fixed size, broadcast, holds
the frequent words (a filled filter prunes less, and loses nothing).  Prefixes over the budget are broadcast;
``MOST_HEAVY`` bounds their number.  What a group's task holds does not grow with the table.

Defined results: a null text is empty; a null language is ``und``; repeated rows count again;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custval.llm.common import blocks, give_back, keyed, larger, released, text_bytes
from custval.llm.spelling import places, powers
from custval.session import materialize

#: Bytes between words, and bytes that end a piece.  Fixed values.
BLANKS = b" \t"
STOPS = b".,;:!?\n\v\f\r"
#: Text bytes whose suffixes are counted together in a task.
BLOCK_BYTES = 6 << 20
#: Suffixes of a group, about; a prefix with more than an eighth of them is extended.
GROUP_SUFFIXES = 2 << 20
#: No more prefixes than this are extended: those with the most suffixes.
MOST_HEAVY = 1_000_000
#: 64-bit blocks of the filter of frequent words (16 MB).
FILTER_BLOCKS = 1 << 21

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(STOPS)] = 2
_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes, the same wherever it stands."""
    body, at = text_bytes(strings)
    power = powers(len(body) + 1)
    upto = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body + np.uint64(1)) * power[:-1], out=upto[1:])
    back = np.full(len(body) + 1, _INVERSE, np.uint64)
    back[0] = 1
    return (upto[at[1:]] - upto[at[:-1]]) * np.cumprod(back, dtype=np.uint64)[at[:-1]]


class Block:
    """The words of a block of texts: which word of which language, and where pieces end.

    ``names`` holds the distinct words as "language newline word" (words hold no newline).
    """

    def __init__(self, texts: pa.Array, langs: pa.Array):
        body, at = text_bytes(pc.ascii_lower(pc.fill_null(texts, "")))
        kind = _KIND[body]
        inner = np.zeros(len(body) + 1, bool)
        inner[:-1] = kind == 0
        edge = np.zeros(len(body) + 1, bool)
        edge[at] = True  # a text's start ends the word before
        starts = inner & edge
        starts[1:] |= inner[1:] & ~inner[:-1]
        starts[0] = inner[0]
        begin = np.flatnonzero(starts)
        row = np.searchsorted(at, begin, side="right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), begin) + row  # grows at stops and at texts
        inner = inner[:-1]
        letters = body[inner]
        size = np.diff(np.append(np.cumsum(inner, dtype=np.int32)[begin], len(letters) + 1)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)]) if len(begin) else np.zeros(1, np.int64)
        del kind, edge, starts, inner
        words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        lang = pc.fill_null(langs, "und").dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        width = max(len(words.dictionary), 1)
        pair, self.word = np.unique(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * width + code, return_inverse=True)
        self.plain = words.dictionary.take(pa.array(pair % width))
        spoken = pc.cast(lang.dictionary, pa.large_string()).take(pa.array(pair // width))
        self.names = pc.binary_join_element_wise(spoken, self.plain, pa.scalar("\n", pa.large_string()))
        self.spoken = spoken
        self.together = piece[1:] == piece[:-1]

    def counts(self) -> tuple[pa.Array, np.ndarray]:
        """Names and how often each occurs; the name without a word has the number of all words of its language."""
        times = np.bincount(self.word, minlength=len(self.names))
        lang = self.spoken.dictionary_encode()
        total = np.bincount(lang.indices.to_numpy(zero_copy_only=False), times, len(lang.dictionary)).astype(np.int64)
        every = pc.binary_join_element_wise(lang.dictionary, *pa.array(["", "\n"], pa.large_string()))
        return pa.concat_arrays([self.names, every]), np.concatenate([times, total])

    def leaves(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's truncated tree: first, second and third word (-1: none) of its leaves, in order, and their counts.

        ``frequent`` says which names a suffix may hold.
        """
        n, word = len(self.names), self.word
        good = frequent[word]
        two = self.together & good[1:] & good[:-1]
        at = np.flatnonzero(two)
        three = np.zeros(len(two) + 1, bool)
        three[:-1] = two
        third = np.full(len(at), -1, np.int64)
        more = three[at + 1]
        third[more] = word[at[more] + 2]
        node, which = np.unique(word[at] * n + word[at + 1], return_inverse=True)
        leaf, count = np.unique(which * (n + 1) + third + 1, return_counts=True)
        node = node[leaf // (n + 1)]
        return node // n, node % n, leaf % (n + 1) - 1, count


class Partition:
    """The vertical partitioning: which prefixes are extended, and the group of each leaf."""

    def __init__(self, groups: int, heavy: np.ndarray, held: np.ndarray):
        self.groups, self.heavy, self.held = groups, np.sort(heavy), held

    def frequent(self, hashed: np.ndarray) -> np.ndarray:
        block, bits = places(hashed, len(self.held))
        return (self.held[block] & bits) == bits

    def extended(self, hashed: np.ndarray) -> np.ndarray:
        """Which words are heavy (a false one by its hash only makes the prefix longer)."""
        if not len(self.heavy):
            return np.zeros(len(hashed), bool)
        at = np.minimum(np.searchsorted(self.heavy, hashed), len(self.heavy) - 1)
        return self.heavy[at] == hashed

    def group(self, hashed: np.ndarray, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of every leaf; whether its node of two words is spread over groups."""
        big = self.extended(hashed)
        longer, longest = big[first], big[first] & big[second]
        key = hashed[first]
        key = np.where(longer, key * np.uint64(31) + hashed[second], key)
        key = np.where(longest, key * np.uint64(31) + np.where(third < 0, np.uint64(0), hashed[third]), key)
        return places(key, self.groups)[0], longest


def word_counts(rows: DataFrame) -> DataFrame:
    """name, n: occurrences of every "language newline word", and of all words under the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(larger(batches, limit=BLOCK_BYTES), limit=BLOCK_BYTES):
            names, times = Block(block.column("text"), block.column("lang")).counts()
            yield from parts(pa.record_batch([names, pa.array(times)], names=["name", "n"]))
            del names, times
            give_back()

    counted = rows.mapInArrow(released(run), "name string, n long")
    return counted.groupBy("name").agg(F.sum("n").alias("n"))


def parts(batch: pa.RecordBatch, step: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces with 32-bit strings."""
    for i in range(0, batch.num_rows, step):
        piece = batch.slice(i, step)
        yield pa.record_batch([pc.cast(c, pa.string()) if pa.types.is_large_string(c.type) else c for c in piece.columns], names=piece.schema.names)


def partition(counted: DataFrame, least: int) -> Partition:
    """Plan the groups from the counts of the frequent words (a materialised table name, n)."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits = places(hashes(batch.column("name")), FILTER_BLOCKS)
            yield pa.record_batch([pa.array(block), pa.array(bits.view(np.int64))], names=["block", "bits"])

    words = counted.where(~F.col("name").endswith("\n") & (F.col("n") >= least))
    entered = words.select("name").mapInArrow(enter, "block long, bits long")
    made = entered.groupBy("block").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # at most FILTER_BLOCKS rows
    held = np.zeros(FILTER_BLOCKS, np.uint64)
    held[made["block"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    total = words.agg(F.sum("n")).first()[0] or 0
    share = max(GROUP_SUFFIXES // 8, total // MOST_HEAVY)
    heavy = words.where(F.col("n") > share).select("name").toArrow()["name"].combine_chunks()  # fewer than MOST_HEAVY
    return Partition(-(-total // GROUP_SUFFIXES) or 1, hashes(heavy) if len(heavy) else np.zeros(0, np.uint64), held)


def _packed(columns: list[pa.Array]) -> bytes:
    batch = pa.record_batch(columns, names=["node", "third", "count", "spread"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def subtrees(rows: DataFrame, plan: Partition) -> DataFrame:
    """grp, leaves: for every block of texts and group, the leaves of its subtree (an Arrow stream)."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for piece in blocks(larger(batches, limit=BLOCK_BYTES), limit=BLOCK_BYTES):
            block = Block(piece.column("text"), piece.column("lang"))
            hashed = hashes(block.names)
            first, second, third, count = block.leaves(plan.frequent(hashed))
            group, spread = plan.group(hashed, first, second, third)
            order = np.argsort(group, kind="stable")
            ends = np.flatnonzero(np.diff(group[order], append=-1)) + 1 if len(order) else []
            begin = 0
            for end in ends:
                some = order[begin:end]
                node = pc.binary_join_element_wise(
                    block.names.take(pa.array(first[some])), block.plain.take(pa.array(second[some])), pa.scalar(" ", pa.large_string())
                )
                last = block.plain.take(pa.array(third[some], mask=third[some] < 0))
                data = _packed([node, last, pa.array(count[some]), pa.array(spread[some])])
                yield pa.record_batch([pa.array([group[some[0]]], pa.int64()), pa.array([data], pa.binary())], names=["grp", "leaves"])
                begin = end
            del block, hashed, first, second, third, count, group, spread, order
            give_back()

    return rows.mapInArrow(released(run), "grp long, leaves binary")


def group_counts(trees: list[pa.Table], least: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Names and totals of a group's nodes: inner nodes (and whether other groups hold a part of them), then leaves."""
    joined = pa.concat_tables(trees)
    node = joined["node"].combine_chunks().dictionary_encode()
    last = joined["third"].combine_chunks().dictionary_encode()
    count = joined["count"].to_numpy()
    at = node.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.bincount(at, count, len(node.dictionary)).astype(np.int64)  # exact below 2 ** 53
    spread = np.zeros(len(total), bool)
    spread[at] = joined["spread"].to_numpy()
    keep = np.flatnonzero((total >= least) | spread)
    yield node.dictionary.take(pa.array(keep)), total[keep], spread[keep]
    deep = np.flatnonzero(pc.is_valid(last).to_numpy(zero_copy_only=False))
    deep = deep[total[at[deep]] >= least] if not spread.any() else deep[(total >= least)[at[deep]] | spread[at[deep]]]
    third = pc.fill_null(last.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)[deep]
    width = max(len(last.dictionary), 1)
    leaf, which = np.unique(at[deep] * width + third, return_inverse=True)
    times = np.bincount(which, count[deep], len(leaf)).astype(np.int64)
    keep = np.flatnonzero(times >= least)
    leaf = leaf[keep]
    names = pc.binary_join_element_wise(
        node.dictionary.take(pa.array(leaf // width)), last.dictionary.take(pa.array(leaf % width)), pa.scalar(" ", pa.large_string())
    )
    yield names, times[keep], np.zeros(len(keep), bool)


def phrase_counts(rows: DataFrame, plan: Partition, least: int) -> DataFrame:
    """name ("language newline words"), n: all phrases of two and three words that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trees = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for names, total, spread in group_counts(trees, least):
                yield from parts(pa.record_batch([names, pa.array(total), pa.array(spread)], names=["name", "n", "spread"]))

        for batch in batches:
            for group, leaves in zip(batch.column("grp").to_pylist(), batch.column("leaves"), strict=True):
                if group != now and trees:
                    yield from done()
                    trees = []
                    give_back()
                now = group
                trees.append(pa.ipc.open_stream(leaves.as_buffer()).read_all())
        if trees:
            yield from done()

    dealt = subtrees(rows, plan).repartitionById(plan.groups, F.col("grp").cast("int"))  # a task for every group
    made = materialize(dealt.mapInArrow(released(run), "name string, n long, spread boolean"), "phrases")
    apart = made.where("spread").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return made.where("not spread").select("name", "n").union(apart)


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of two and three words with a = f(phrase) >= ``least``; a cut into l = f(first part) and
    r = f(rest) scores floor(10**6 a a / (l r)), and the lowest cut counts (ties: the first).  A candidate
    inside a longer one that occurs half as often or more is dropped.
    """
    rows = keyed(docs, text=text_col, lang=lang_col)
    counted = materialize(word_counts(rows).where((F.col("n") >= least) | F.col("name").endswith("\n")), "words")
    found = materialize(phrase_counts(rows, partition(counted, least), least), "candidates")

    spoken = F.regexp_extract("name", r"(?s)^(.*)\n", 1)
    word = F.split(F.regexp_extract("name", r"([^\n]*)$", 1), " ")
    base = found.select("name", F.col("n").alias("a"), spoken.alias("lang"), word.alias("w"))

    def named(first: Column, size: Column) -> Column:
        return F.concat("lang", F.lit("\n"), F.array_join(F.slice("w", first, size), " "))

    ks = F.sequence(F.lit(1), F.size("w") - 1)
    cuts = base.select("name", "lang", "w", "a", F.explode(ks).alias("k"))
    cuts = cuts.select("name", "a", "k", named(F.lit(1), F.col("k")).alias("left"), named(F.col("k") + 1, F.size("w")).alias("right"), (F.size("w") == 3).alias("longer"))
    known = counted.union(found)
    sized = cuts.join(known.select(F.col("name").alias("left"), F.col("n").alias("l")), "left")
    sized = materialize(sized.join(known.select(F.col("name").alias("right"), F.col("n").alias("r")), "right"), "cuts")
    score = F.expr("(1000000BD * cast(a AS decimal(14,0)) * cast(a AS decimal(14,0))) div (cast(l AS decimal(14,0)) * cast(r AS decimal(14,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = sized.groupBy("name", "a").agg(best)
    inside = F.when(F.col("k") == 1, F.struct(F.col("right").alias("name"), F.col("r").alias("n"))).otherwise(F.struct(F.col("left").alias("name"), F.col("l").alias("n")))
    covered = sized.where("longer").select("a", inside.alias("part")).where(100 * F.col("a") >= 50 * F.col("part.n")).select("part.name").distinct()
    rows = scored.join(covered, "name", "left_anti").select(
        spoken.alias("lang"), F.regexp_extract("name", r"([^\n]*)$", 1).alias("phrase"), "a", "cut.l", "cut.r", "cut.score"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counted.where(F.col("name").endswith("\n")).select(F.col("name").substr(F.lit(1), F.length("name") - 1).alias("lang"), "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
