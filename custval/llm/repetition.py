"""Quality rules on repetition within a text, by suffix arrays over words.

Each task sorts the suffixes of its texts' word sequences (prefix doubling that
goes on only where suffixes still tie), takes the longest common prefix (LCP) of
neighbours, and reads the maximal repeated substrings off the LCP intervals: the
suffix at word ``i`` starts an occurrence of a repeated substring of
``max(lcp with its neighbours)`` words, and no longer one.  The union of these
occurrences is the repeated part of the text.

Texts are independent, so the operator is one narrow pass: no shuffle, and a
lost executor repeats only its own tasks.  Memory is bounded by the block of
texts that is sorted at a time (``common.BLOCK_BYTES``, or one longer text).

Defined results: a null or empty text has no words and fails the base rule;
texts shorter than a window have no repeats; repeated rows are judged alike and
all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from custval.llm.common import blocks, byte_lengths, keyed, released, rows_of, split_codes, text_bytes, word_codes

#: Base rule: window of words, least words, largest percentage of words in repeated windows.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

#: Method: least words of a repeated substring; limits of the verdict.
MIN_REPEAT = 6
MAX_COVERED = 0.30
MAX_LONGEST_SHARE = 0.15

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_chars long, covered_fraction double, longest_repeat long, n_repeats long, base_failed boolean, kept boolean"
)


def suffix_order(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of many word sequences at once.

    Returns the suffixes ordered by (row, words), and for k = 1, 2, 4, ... the
    rank of every position by its first k words (equal rank: equal words, all
    within the row).  Positions whose rank is already unique are not sorted again.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), []
    row = rows_of(offsets)
    end = offsets[1:][row]
    key = row * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # ranks are positions of a group's first suffix
    rank = np.empty(n, np.int64)
    rank[order] = start
    ranks, k = [rank.astype(np.int32)], 1
    size = np.diff(np.append(np.flatnonzero(first), n))
    active = order[np.repeat(size > 1, size)]
    while len(active):
        follow = active + k
        inside = follow < end[active]
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        old = rank[active]
        key = old * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, old, key = active[by], old[by], key[by]
        fresh = np.concatenate([[True], np.diff(old) != 0])
        split = np.concatenate([[True], np.diff(key) != 0])
        index = np.arange(len(active))
        base = np.maximum.accumulate(np.where(fresh, index, 0))
        new = old + np.maximum.accumulate(np.where(split, index, 0)) - base
        rank = rank.copy()
        rank[active] = new
        order[old + index - base] = active
        ranks.append(rank.astype(np.int32))
        size = np.diff(np.append(np.flatnonzero(split), len(active)))
        active = active[np.repeat(size > 1, size)]
        k *= 2
    return order, ranks


def longest_repeats(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, LCP of each suffix with the one before it, longest repeat that starts at each position)."""
    order, ranks = suffix_order(codes, offsets)
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n:
        row = rows_of(offsets)
        end = offsets[1:][row]
        pair = 1 + np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
        a, b = order[pair - 1], order[pair]
        length = np.zeros(len(pair), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = a + length, b + length
            go = (x < end[a]) & (y < end[b])
            r = ranks[level]
            go &= r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)]
            length += go << level
        lcp[pair] = length
    repeat = np.zeros(n, np.int64)
    repeat[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return order, lcp, repeat


def spans_union(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions covered by any span."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, codes: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Row of every maximal repeated substring of ``least`` words or more, one element for each.

    A maximal repeat is an LCP interval (it cannot be extended to the right)
    whose occurrences do not all follow the same word (nor to the left).  The
    intervals come from the usual stack over the suffixes that share such a prefix.
    """
    at = np.flatnonzero(lcp >= least)
    if not len(at):
        return np.zeros(0, np.int64)
    row = rows_of(offsets)
    before = np.where(order > offsets[:-1][row[order]], codes[np.maximum(order - 1, 0)], -1)

    def both(a: int, b: int) -> int:
        return a if a == b else -1  # -1: differing words, or the start of the text

    found: list[int] = []
    for run in np.split(at, 1 + np.flatnonzero(np.diff(at) != 1)):
        of = int(row[order[run[0]]])
        heights = [*lcp[run].tolist(), 0]
        leaves = before[run[0] - 1 : run[-1] + 1].tolist()
        stack: list[list[int]] = []  # [words shared, the one word before all occurrences or -1]
        for height, last in zip(heights, leaves, strict=True):
            while stack and stack[-1][0] > height:
                top = stack.pop()
                last = both(top[1], last)
                if last == -1:
                    found.append(of)
            if height:
                if stack and stack[-1][0] == height:
                    stack[-1][1] = both(stack[-1][1], last)
                else:
                    stack.append([height, last])
    return np.asarray(found, np.int64)


def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts and verdicts of one block of rows (doc_id, text)."""
    texts = batch.column("text")
    rows = batch.num_rows
    codes, offsets, words = word_codes(texts)
    n_words = np.diff(offsets)
    row = rows_of(offsets)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    word_chars = np.bincount(row, chars, rows).astype(np.int64)

    body, at = text_bytes(texts)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    n_symbols = np.diff(np.concatenate([[0], np.cumsum(symbol[body])])[at])

    line, line_offsets, lines = split_codes(pc.split_pattern(pc.fill_null(texts, ""), "\n"))
    real = byte_lengths(pc.ascii_trim_whitespace(lines)) > 0
    keep = real[line]
    line_row = rows_of(line_offsets)[keep]
    distinct = np.unique(line_row * (len(lines) + 1) + line[keep]) // (len(lines) + 1)
    n_dup_lines = np.bincount(line_row, minlength=rows) - np.bincount(distinct, minlength=rows)

    order, lcp, repeat = longest_repeats(codes, offsets)
    n = len(codes)
    window = np.flatnonzero(repeat >= WINDOW)
    n_repeat_words = np.bincount(row[spans_union(window, np.full(len(window), WINDOW), n)], minlength=rows)

    start = np.flatnonzero(repeat >= MIN_REPEAT)
    covered = spans_union(start, repeat[start], n)
    covered_chars = np.bincount(row[covered], chars[covered], rows).astype(np.int64)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row[start], repeat[start])
    n_repeats = np.bincount(maximal_repeats(order, lcp, codes, offsets, MIN_REPEAT), minlength=rows)

    failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)
    fraction = covered_chars / np.maximum(word_chars, 1)
    kept = ~failed & (fraction <= MAX_COVERED) & (longest <= MAX_LONGEST_SHARE * n_words)
    return pa.record_batch(
        [batch.column("doc_id")]
        + [pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_chars)]
        + [pa.array(fraction, pa.float64()), pa.array(longest, pa.int64()), pa.array(n_repeats, pa.int64())]
        + [pa.array(failed), pa.array(kept)],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repetition counts and the verdict ``kept`` of every row of ``docs``.

    ``covered_fraction`` is the share of the words' characters inside repeated
    substrings of ``MIN_REPEAT`` words or more, ``longest_repeat`` the words of
    the longest one, ``n_repeats`` how many maximal ones there are.  A text is
    kept if the base rule holds, at most ``MAX_COVERED`` is covered, and the
    longest repeat is at most ``MAX_LONGEST_SHARE`` of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield judge(block)

    return keyed(docs, doc_id=id_col, text=text_col).mapInArrow(released(run), SCHEMA)
