"""Language identification by cross-parsing with suffix automata.

For every language a suffix automaton holds all substrings of a bounded sample of
labelled words.  A text is parsed into phrases, each the longest match in the
language's automaton from where the last one ended; a text in the language needs
few, long phrases.  The language with the fewest phrases per character wins.
Phrases do not cross words, so equal words need equal numbers of phrases and each
distinct word of a block is parsed once, all of them in step (numpy); a long word (a line
of a script without blanks) by the matches of all its places.

The fit gathers at most ``SAMPLE_WORDS`` words for each language, from at most
``SAMPLE_DOCS`` labelled texts of each; these bounds do not depend on the size of
the table.  The prediction is one narrow pass over whole texts: no shuffle.

Defined results: ``und`` with score 0 for a text that is null or has no letter, or
if nothing was learned; languages that need equally many phrases: the first by
code point; repeated rows get equal answers; an empty table gives an empty result;
null languages teach nothing; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custval.llm.common import blocks, keyed, released, rows_of, word_codes

#: Bounds of the fit, for each language: sampled texts, words kept, and the letters of a word; longer words
#: (lines of scripts without blanks) are cut into pieces.
SAMPLE_DOCS = 400
SAMPLE_WORDS = 4000
LONGEST_WORD = 40
#: Words of more letters are parsed by the matches of all their places, shorter ones letter by letter in step.
STEPPED = 100
UNKNOWN = "und"

Model = tuple[tuple[str, tuple[str, ...]], ...]


def letters(words: pa.Array) -> pa.Array:
    """Lower-case words without what is not a letter."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"\P{L}+", "")


def _pieces(word: str) -> list[str]:
    """A long word in lower case, cut where it has no letter and then at LONGEST_WORD letters."""
    runs = pc.split_pattern_regex(pa.array([word.lower()]), r"\P{L}+").to_pylist()[0]
    return sorted({run[i : i + LONGEST_WORD] for run in runs for i in range(0, len(run), LONGEST_WORD)})


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        codes, offsets, words = word_codes(block.column("text"))
        pairs = np.unique(rows_of(offsets) * (len(words) + 1) + codes)
        row, code = pairs // (len(words) + 1), pairs % (len(words) + 1)
        plain = letters(words)
        long = pc.utf8_length(plain).to_numpy(zero_copy_only=False) > LONGEST_WORD
        cut = {c: _pieces(words[c].as_py()) for c in np.flatnonzero(long).tolist()}
        more = sorted({(r, piece) for r, c in zip(row[long[code]].tolist(), code[long[code]].tolist(), strict=True) for piece in cut[c]})
        row, code = row[~long[code]], code[~long[code]]
        rows = np.concatenate([row, np.array([r for r, _ in more], np.int64)])
        found = pa.concat_arrays([plain.take(pa.array(code)), pa.array([piece for _, piece in more], plain.type)])
        yield pa.record_batch([block.column("lang").take(pa.array(rows)), found], names=["lang", "word"])


def _below(lang: str, limit: int | None) -> Column:
    """Rows of a language whose hash is within its bound (none: all of them)."""
    same = F.col("lang") == lang
    return same if limit is None else same & (F.col("hash") <= limit)


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn the words of each language: those in most sampled texts (ties by code point).

    The sample is the distinct texts of smallest hash, so it does not depend on ids,
    order, copies or partitions.  Which hashes are small enough is settled on hashes
    alone (approximate counts of distinct ones, then the exact few below a bound), so
    only the sampled texts leave the scan.
    """
    rows = keyed(labelled, text=text_col, lang=lang_col).where("lang is not null and text is not null")
    rows = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 1))  # 63 bits
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"))
    share = F.least(F.lit(4.0 * SAMPLE_DOCS) / F.col("n"), F.lit(1.0))
    bound = counts.select("lang", F.when(F.col("n") > 4 * SAMPLE_DOCS, (share * 2.0**63).cast("long")).alias("bound"))
    # one row per language: an upper bound that about four times the sample stays below
    limits = {r.lang: r.bound for r in bound.collect()}
    low = reduce(lambda a, b: a | b, [_below(lang, limit) for lang, limit in limits.items()], F.lit(False))
    few = rows.where(low).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("hash")
    sample = few.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= SAMPLE_DOCS).select("lang", "text")
    words = (
        sample.mapInArrow(released(_sample_words), "lang string, word string")
        .where(F.length("word") > 0)
        .groupBy("lang", "word")
        .agg(F.count("*").alias("docs"))
    )
    most = Window.partitionBy("lang").orderBy(F.desc("docs"), "word")
    kept = words.withColumn("n", F.row_number().over(most)).where(F.col("n") <= SAMPLE_WORDS)
    learned: dict[str, list[str]] = {}
    for r in kept.select("lang", "word").collect():  # bounded: SAMPLE_WORDS for each language
        learned.setdefault(r.lang, []).append(r.word)
    return tuple((lang, tuple(sorted(learned[lang]))) for lang in sorted(learned))


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton of all substrings of ``text``; state 0 is the empty string."""
    goto: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return goto


class Transitions:
    """An automaton's transitions in an open-addressing hash table, so that memory grows with them and not with the alphabet."""

    def __init__(self, goto: list[dict[str, int]], place: dict[str, int]):
        self.symbols = len(place) + 1  # one for characters that the model does not have
        n = sum(map(len, goto))
        keys = np.fromiter((state * self.symbols + place[c] for state, to in enumerate(goto) for c in to), np.int64, n)
        values = np.fromiter((t for to in goto for t in to.values()), np.int32, n)
        bits = max(4, (2 * n).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(n), self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # of several that want a slot, one stays
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.values[slot] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def after(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states (-1: none)."""
        keys = state * self.symbols + symbol
        slot = self._slot(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.values[slot], -1)
        left = np.flatnonzero((met != keys) & (met >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            met = self.keys[slot[left]]
            same = met == keys[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (met >= 0)]
        return out


@lru_cache(maxsize=1)
def tables(model: Model) -> tuple[np.ndarray, list[Transitions]]:
    """The model's characters (sorted code points, blank first) and each language's transitions."""
    texts = [" " + " ".join(words) + " " for _, words in model]
    alphabet = sorted(set("".join(texts)) | {" "})
    place = {c: i for i, c in enumerate(alphabet)}
    return np.array([ord(c) for c in alphabet], np.uint32), [Transitions(suffix_automaton(text), place) for text in texts]


def phrases_of(symbols: np.ndarray, table: Transitions) -> int:
    """Phrases of one long string.

    The longest match from every place, all places in step (no match is longer than the model's
    words), then the places from phrase to phrase: as many phrases as letter by letter.
    """
    n = len(symbols)
    live, state, match = np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64)
    size = 0
    while len(live):
        to = table.after(state, symbols[live + size])
        size += 1
        met = to >= 0
        live, state = live[met], to[met].astype(np.int64)
        match[live] = size
        inside = live + size < n
        live, state = live[inside], state[inside]
    ends = (np.arange(n) + match).tolist()
    count = at = 0
    while at < n:
        at = ends[at]
        count += 1
    return count


def count_phrases(words: pa.Array, model: Model) -> np.ndarray:
    """Phrases that each word needs in each language, the blanks around it included."""
    alphabet, automata = tables(model)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
    symbols = np.where(alphabet[at] == points, at, len(alphabet))
    begin = np.cumsum(length) - length
    stepped = np.where(length > STEPPED, 0, length)
    order = np.argsort(-stepped, kind="stable")
    start = begin[order]
    sorted_length = stepped[order]
    blank = int(np.searchsorted(alphabet, ord(" ")))
    out = np.zeros((len(words), len(model)), np.int64)
    every = np.arange(len(alphabet) + 1)
    for k, table in enumerate(automata):
        root = table.after(np.zeros(len(every), np.int64), every).astype(np.int64)
        state = np.full(len(words), max(int(root[blank]), 0))
        count = np.zeros(len(words), np.int64)

        def step(live: int, c: np.ndarray, state=state, count=count, table=table, root=root) -> None:
            now = state[:live]
            to = table.after(now, c)
            stuck = np.flatnonzero(to < 0)
            if len(stuck):  # the phrase ends before c; c starts the next, or is one by itself
                fresh = root[c[stuck]]
                count[stuck] += (now[stuck] > 0).astype(np.int64) + (fresh < 0)
                to[stuck] = np.maximum(fresh, 0)
            state[:live] = to

        for i in range(int(sorted_length[0]) if len(sorted_length) else 0):
            live = int(np.searchsorted(-sorted_length, -i, side="left"))  # words longer than i
            step(live, symbols[start[:live] + i])
        step(len(words), np.full(len(words), blank))
        out[order, k] = count + (state > 0)
    for i in np.flatnonzero(length > STEPPED):
        whole = np.concatenate([[blank], symbols[begin[i] : begin[i] + length[i]], [blank]])
        out[i] = [phrases_of(whole, table) for table in automata]
    return out


def predict(block: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    codes, offsets, words = word_codes(block.column("text"))
    plain = letters(words).dictionary_encode()
    distinct = plain.dictionary
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    word = plain.indices.to_numpy(zero_copy_only=False)[codes] if len(codes) else codes
    total = np.concatenate([[0], np.cumsum(np.where(length > 0, length + 1, 0)[word])])[offsets]
    chars = np.diff(total)
    names = [lang for lang, _ in model]
    phrases = np.zeros((block.num_rows, len(names)), np.int64)
    if names:
        each = np.where(length[:, None] > 0, count_phrases(distinct, model), 0)
        for k in range(len(names)):
            phrases[:, k] = np.diff(np.concatenate([[0], np.cumsum(each[:, k][word])])[offsets])
    known = (chars > 0) & bool(names)
    best = np.argmin(phrases, axis=1) if names else np.zeros(block.num_rows, np.int64)
    least = phrases.min(axis=1, initial=2**62)
    score = np.where(known, 1.0 / np.maximum(np.exp(np.minimum(least[:, None] - phrases, 0)).sum(axis=1), 1.0), 0.0)
    langs = pa.array([names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
    rate = np.where(known, least / np.maximum(chars, 1), 0.0)
    return pa.record_batch(
        [block.column("doc_id"), langs, pa.array(score, pa.float64()), pa.array(chars, pa.int64()), pa.array(rate, pa.float64())],
        names=["doc_id", "lang_pred", "score", "n_letters", "phrase_rate"],
    )


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None
) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, n_letters, phrase_rate, then the ``keep`` columns (new name: column).

    ``score`` is the share of the winner in the sum of e**-phrases over the
    languages; ``n_letters`` counts letters and one blank per word;
    ``phrase_rate`` is the winner's phrases per such character.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_WORDS for each language
    keep = keep or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = predict(block, shared.value)
            columns = [*found.columns, *[block.column(k) for k in keep]]
            yield pa.record_batch(columns, names=[*found.schema.names, *keep])

    rows = keyed(docs, doc_id=id_col, text=text_col, **keep)
    schema = T.StructType.fromDDL("doc_id long, lang_pred string, score double, n_letters long, phrase_rate double")
    for name in keep:
        schema = schema.add(name, rows.schema[name].dataType)
    return rows.mapInArrow(released(run), schema)


def held_out(id_col: str = "doc_id"):
    """The held-out quarter of the documents: crc32 of the id's decimal text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def label_languages(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out, predict all of them."""
    model = fit_languages(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_letters", "phrase_rate")
