"""Spelling variants: neighbourhoods of one edit, guided by Bloom filters.

The vocabulary's words are entered into blocked Bloom filters, one for each word
length (a word sets a few bits of one 64-bit block).  A word's neighbours are then
generated: every deletion of a letter, and every replacement by a letter that comes
later in the alphabet (insertions and replacements by earlier letters are the same
pairs seen from the other word).  A word's hash is a polynomial of its letters, so an
edit's hash takes two operations, without building the edited word.  Each edit is
probed in the filter of its length; only positives are written out, as words, and
joined with the vocabulary, which removes the false ones.

The filters are broadcast.  Their size follows the vocabulary, so it is counted first:
beyond ``FILTER_BYTES`` they are cut into ranges of blocks, and one range after another
is broadcast and probed.  Hits are bounded by the edits of a word; nothing is grouped by
anything that two words share but a word itself.

Defined results: a null text has no words; a null id counts as an empty string in the
hash of a run; repeated rows count again; without words the result is empty; other
columns are ignored.  Ties go to the smallest word in code-point order.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custval.llm.common import keyed, larger, released
from custval.session import materialize

#: A letter of a word: ASCII, or U+00C0 to U+00FF.
LETTER = r"[A-Za-zÀ-ÿ]"
#: Filter bits for a word of length n: this many, or 2 n if that is more (longer words have more edits).
WORD_BITS = 16
#: Bits that a word sets in its block.
SET_BITS = 5
#: Bytes of filters that are broadcast and probed at a time.
FILTER_BYTES = 32 << 20
#: (word, position) pairs that are probed in one vectorised step.
PROBED = 100_000

_BASE = 0x9E3779B97F4A7C15  # an odd number: its powers have inverses modulo 2 ** 64
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def word_counts(docs: DataFrame, least: int = 7, occurrences: int = 2, typo: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least ``least`` letters that occur ``occurrences`` times or more.

    A word is a lower-cased run of letters.  Where ``typo`` divides the crc32 h of ``<id>:<run>``
    the run's letter h % length (from 0) is deleted; 0 leaves all runs as they are.
    """
    rows = keyed(docs, doc_id=id_col, text=text_col)
    runs = F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least},}}"), F.lit(0))  # a deletion only shortens
    words = rows.select("doc_id", F.explode(runs).alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("word"))
    if typo:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
        size, word = F.char_length("word"), F.col("word")
        place = (F.col("h") % size).cast("int")
        cut = F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, size))
        words = words.withColumn("h", h).select(F.when(F.col("h") % typo == 0, cut).otherwise(word).alias("word"))
        words = words.where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2 ** 64."""
    factors = np.full(n, _BASE, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash among ``blocks`` (under 2 ** 32), and the bits set there."""
    x = hashes ^ (hashes >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    block = ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits = np.zeros(len(x), np.uint64)
    for i in range(SET_BITS):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return block.astype(np.int64), bits


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places of its words, and their code points as a matrix."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        joined = "".join(words.take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(at), n)


def texts_of(codes: np.ndarray) -> list[str]:
    """The words whose code points are the rows of a matrix."""
    n, joined = codes.shape[1], codes.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + n] for i in range(0, len(joined), n)]


class Filters:
    """Where the filter of each word length stands among all blocks, and one range of the blocks."""

    def __init__(self, words: dict[int, int]):
        self.blocks = {n: -(-count * max(WORD_BITS, 2 * n) // 64) for n, count in sorted(words.items())}
        ends = np.cumsum(list(self.blocks.values()))
        self.first = dict(zip(self.blocks, (ends - list(self.blocks.values())).tolist(), strict=True))
        self.total = int(ends[-1]) if len(ends) else 0
        self.low, self.bits = 0, np.zeros(0, np.uint64)

    def load(self, low: int, blocks: np.ndarray, bits: np.ndarray, size: int) -> Filters:
        """Hold the blocks from ``low`` on."""
        self.low, self.bits = low, np.zeros(size, np.uint64)
        self.bits[blocks - low] = bits.view(np.uint64)
        return self

    def holds(self, n: int) -> bool:
        """Whether words of a length may be in the range."""
        return n in self.blocks and self.first[n] < self.low + len(self.bits) and self.first[n] + self.blocks[n] > self.low

    def entries(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of every word."""
        blocks, bits = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64)
        for at, codes in by_length(words):
            n = codes.shape[1]
            block, bits[at] = places((codes * powers(n)).sum(axis=1, dtype=np.uint64), self.blocks[n])
            blocks[at] = block + self.first[n]
        return blocks, bits

    def probe(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Which of the hashes of words of length n the range may hold."""
        block, bits = places(hashes, self.blocks[n])
        block += self.first[n] - self.low
        if self.low <= self.first[n] and self.first[n] + self.blocks[n] <= self.low + len(self.bits):
            return np.flatnonzero((self.bits[block] & bits) == bits)
        inside = np.flatnonzero((block >= 0) & (block < len(self.bits)))
        return inside[(self.bits[block[inside]] & bits[inside]) == bits[inside]]

    def neighbours(self, words: pa.Array, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Places of words, and edits of them that the range may hold."""
        for at, codes in by_length(words):
            n = codes.shape[1]
            power = powers(n)
            step = max(1, PROBED // n)
            for i in range(0, len(at), step):
                for rows, made in self._edits(codes[i : i + step], power, alphabet):
                    for j in range(0, len(rows), step):  # long words a few at a time
                        yield at[i + rows[j : j + step]], texts_of(made(slice(j, j + step)))

    def _edits(self, codes: np.ndarray, power: np.ndarray, alphabet: np.ndarray):
        n = codes.shape[1]
        terms = codes * power
        whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
        if self.holds(n - 1):
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            edited = before + (whole - before - terms) * _INVERSE
            new = np.ones(codes.shape, bool)
            new[:, 1:] = codes[:, 1:] != codes[:, :-1]  # the first of equal letters stands for all
            pairs = np.flatnonzero(new)
            pairs = pairs[self.probe(edited.ravel()[pairs], n - 1)]
            rows, cut = np.divmod(pairs, n)
            kept = np.arange(n - 1)
            yield rows, lambda s, rows=rows, cut=cut: codes[rows[s][:, None], kept + (kept >= cut[s][:, None])]
        if self.holds(n):
            flat, terms, weight = codes.ravel(), terms.ravel(), np.tile(power, len(codes))
            base = np.repeat(whole.ravel(), n) - terms
            for letter in alphabet:
                pairs = np.flatnonzero(flat < letter)
                if not len(pairs):
                    continue
                pairs = pairs[self.probe(base[pairs] + np.uint64(letter) * weight[pairs], n)]
                rows, place = np.divmod(pairs, n)

                def made(s, rows=rows, place=place, letter=letter):
                    out = codes[rows[s]]
                    out[np.arange(len(out)), place[s]] = letter
                    return out

                yield rows, made


def candidates(words: DataFrame, sizes: dict[int, int], low: int, size: int, alphabet: np.ndarray) -> DataFrame:
    """edit, word, n: the edits that the filters' blocks ``low`` to ``low + size`` may hold."""
    sc, filters = words.sparkSession.sparkContext, Filters(sizes)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger(batches, "word", 1 << 18):
            blocks, bits = filters.entries(batch.column("word"))
            yield pa.record_batch([pa.array(blocks), pa.array(bits.view(np.int64))], names=["block", "bits"])

    entered = words.select("word").mapInArrow(enter, "block long, bits long").where(F.col("block").between(low, low + size - 1))
    # at most FILTER_BYTES / 8 blocks
    made = entered.groupBy("block").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    shared = sc.broadcast(Filters(sizes).load(low, made["block"].to_numpy(), made["bits"].to_numpy(), size))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger(batches, "word", 1 << 18):
            for at, edits in shared.value.neighbours(batch.column("word"), alphabet):
                if edits:
                    yield pa.record_batch([pa.array(edits, pa.string()), *batch.take(pa.array(at)).columns], names=["edit", "word", "n"])

    found = materialize(words.select("word", "n").mapInArrow(released(probe), "edit string, word string, n long"), "edits")
    shared.destroy()
    return found


def near_words(words: DataFrame) -> DataFrame:
    """word, other, other_n: every two words (of a materialised table word, n) that are one edit apart, both ways."""
    spark = words.sparkSession
    # one row for each length of a word, one for each letter
    sizes = {r.size: r.words for r in words.groupBy(F.char_length("word").alias("size")).agg(F.count("*").alias("words")).collect()}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct().collect()
    alphabet = np.sort(np.array([ord(r.c) for r in letters], np.uint32))
    total, step = Filters(sizes).total, FILTER_BYTES // 8
    found = spark.createDataFrame([], "edit string, word string, n long")
    for low in range(0, total, step):
        found = found.union(candidates(words, sizes, low, min(step, total - low), alphabet))
    known = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pair = found.join(known, "edit")

    def way(word: str, other: str, n: str) -> Column:
        return F.struct(F.col(word).alias("word"), F.col(other).alias("other"), F.col(n).alias("other_n"))

    return pair.select(F.inline(F.array(way("word", "edit", "edit_n"), way("edit", "word", "n"))))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that the forms (word, form) lead to, by doubling the steps of every word at a time.

    A form occurs several times as often as its word, so a chain is no longer than the logarithm of the counts.
    """
    done = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = done.select(F.col("word").alias("root"), F.col("root").alias("further"))
        done = materialize(done.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if done.where("moved").isEmpty():
            return done.select("word", "root")
        done = done.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Group the words (word, n) of a vocabulary, each once, under their frequent spellings.

    One row per word: word, form, root, n, n_near, form_n.  ``form`` is the most frequent word one edit away
    (one code point inserted, deleted or replaced) if it occurs ``ratio`` times as often or more, else null.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    far = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word",
        F.when(far, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, -F.col("best.less")).alias("form_n"),
    )
    rows = materialize(rows, "variants")
    last = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
