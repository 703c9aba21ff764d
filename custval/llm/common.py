"""Helpers shared by the operators: reading tables, Arrow blocks, word codes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step holds at a time in a task (a longer document is a step of its own).
BLOCK_BYTES = 2 << 20

#: A word, in Java's and Python's regular expressions alike: six ASCII blanks separate words.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch between Spark and its Python workers where the rows are documents: both sides
#: hold whole batches, and documents are large rows.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the data folder, for a query; the session's Arrow batches become BATCH_ROWS at most."""
    document_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to BATCH_ROWS rows (queries and pipeline stages call this, operators do not)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that each holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(byte_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def larger(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Put consecutive Arrow batches together until they hold ``limit`` bytes of ``column``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(byte_lengths(batch.column(column)).sum())
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Return Arrow's and, where it can (glibc), the C library's unused memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """A batch function that gives unused memory back when its task ends: the worker lives on for others."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of every text, 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every element, given the offsets of the rows."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def split_codes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Dictionary codes of a list column's elements, row offsets, dictionary."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], encoded.dictionary


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of every text as dictionary codes: (codes, row offsets, dictionary).

    Words are runs without the blanks 0x20 and 0x09-0x0D.  Null counts as empty.
    Equal words have equal codes within the call.
    """
    codes, offsets, words = split_codes(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # leading and trailing blanks leave empty pieces
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, offsets, words


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts, one after another, and the row offsets."""
    joined = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
    data = joined.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def gather(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values ``flat[at[r]:at[r + 1]]`` of the given rows, one after another."""
    size = np.diff(at)[rows]
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return flat[np.repeat(at[rows], size) + inner]


class Known:
    """Ids of the distinct strings met so far, in Arrow and numpy arrays: the bounded memory of a Python worker."""

    def __init__(self, most: int, most_bytes: int = 64 << 20):
        self.most, self.most_bytes = most, most_bytes
        self.forget()

    def forget(self) -> None:
        self.strings = pa.array([], pa.large_string())
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def numbers(self, strings: pa.Array, learn) -> np.ndarray:
        """The numbers of distinct strings in the store.

        ``learn`` gets those that are new and returns their ids, one after another,
        and how many each has.
        """
        strings = pc.cast(strings, pa.large_string())
        if len(self.strings) > self.most or self.strings.nbytes > self.most_bytes:
            self.forget()
        numbers = pc.index_in(strings, self.strings)
        unknown = pc.is_null(numbers)
        numbers = pc.fill_null(numbers, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = strings.filter(unknown)
        if len(new):
            flat, size = learn(new)
            numbers[numbers < 0] = np.arange(len(self.strings), len(self.strings) + len(new))
            self.strings = pa.concat_arrays([self.strings, new])
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        return numbers

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered strings, one after another, and their offsets."""
        size = np.diff(self.at)[numbers]
        return gather(self.flat, self.at, numbers), np.concatenate([[0], np.cumsum(size)])


def keyed(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Project to the named inputs of an operator, so that further columns (of any name) do not matter."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
