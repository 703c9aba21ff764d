"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector (signed counts by the hash of the id,
damped, of unit length), which a fixed random projection takes to ``AXES`` dimensions.
The Hilbert key of that point orders the documents: neighbours on the curve are
neighbours in space, so near documents come into the same sequence.

The work is one narrow pass (ids and key), one exchange by ranges of the key, and one
pass in key order that cuts the running ids into sequences.  A task needs no word of the
others: it fills whole sequences, and cuts what is left at its end at powers of two, so
that nothing is padded.  Equal keys (copies) are dealt out by id and row, so a large group of
copies spreads over tasks.  A task holds one sequence and one batch of documents.

Defined results: a null text is empty (it holds the end id only); a null id stays null; repeated
rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custval.llm.common import blocks, keyed, released
from custval.llm.ranked import byte_level
from custval.session import materialize

#: Dimensions of the hashed vectors and of their projection, and bits of each projected coordinate.
HASHED = 256
AXES = 4
AXIS_BITS = 15
#: Tokens of a range of the curve (one task), about.
RANGE_TOKENS = 4 << 20
#: Longer documents are dealt in pieces of so many tokens, all with the document's key: ranges even out rows, not tokens.
PIECE_TOKENS = 1 << 13
#: Text bytes encoded, and vectors projected, at a time.
ENCODE_BYTES = 4 << 20
VECTORS = 4096
SEED = 11


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows of coordinates below 2 ** bits), after Skilling (2004).

    At most 63 bits in all.
    """
    x = points.T.astype(np.int64).copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of the cells, from the largest
        bit, below = 1 << level, (1 << level) - 1
        for i in range(axes):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, axes):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> level & 1)
    return key


class Projector:
    """Hilbert keys of documents given as token ids."""

    def __init__(self, vocabulary: int):
        rnd = np.random.default_rng(SEED)
        self.bucket = rnd.integers(0, HASHED, vocabulary)
        self.sign = rnd.choice([-1.0, 1.0], vocabulary)
        self.axes = rnd.normal(size=(HASHED, AXES))

    def vectors(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashed vectors of unit length (zero for a document without ids)."""
        n = len(at) - 1
        cell = np.repeat(np.arange(n) * HASHED, np.diff(at)) + self.bucket[ids]
        counts = np.bincount(cell, self.sign[ids], n * HASHED).reshape(n, HASHED)
        damped = np.sign(counts) * np.sqrt(np.abs(counts))
        return damped / np.maximum(np.sqrt((damped**2).sum(axis=1, keepdims=True)), 1e-12)

    def keys(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at) - 1, np.int64)
        for i in range(0, len(out), VECTORS):
            part = at[i : i + VECTORS + 1]
            y = self.vectors(ids[part[0] : part[-1]], part - part[0]) @ self.axes
            cell = (1 << AXIS_BITS) / (1.0 + np.exp(-1.7 * y))  # about evenly filled: y is near normal
            out[i : i + VECTORS] = hilbert_keys(np.minimum(cell, (1 << AXIS_BITS) - 1).astype(np.int64), AXIS_BITS)
        return out


@lru_cache(maxsize=1)
def _reader(data: bytes):
    encoding = byte_level(data)
    return encoding, Projector(encoding.n_vocab)


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, row, start, n_tokens, ids (16 or 32 bits each): every document's ids with its key on the curve.

    Long documents come in pieces; ``start`` counts the ids before a piece, ``n_tokens`` those of the document.
    """
    with open(tokenizer_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of under 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, projector = _reader(shared.value)
        width = np.uint16 if max(encoding.n_vocab, end_id) <= 1 << 16 else np.uint32
        row = TaskContext.get().partitionId() << 40
        for block in blocks(batches, limit=ENCODE_BYTES):
            parts = [encoding.encode_to_numpy(t, allowed_special="all") for t in pc.fill_null(block.column("text"), "").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            flat = np.concatenate(parts)
            keys = projector.keys(flat, at)
            ids = np.insert(flat, at[1:], end_id).astype(width)
            at = at + np.arange(len(at))
            size = np.diff(at)
            pieces = -(-size // PIECE_TOKENS)
            of = np.repeat(np.arange(len(size)), pieces)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE_TOKENS
            cuts = np.append(at[of] + start, at[-1]) * ids.itemsize
            body = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
            columns = [keys[of], row + of, start, size[of]]
            keyed_rows = [pa.array(c) for c in columns]
            row += len(parts)
            doc_ids = block.column("doc_id").take(pa.array(of))
            yield pa.record_batch(
                [keyed_rows[0], doc_ids, *keyed_rows[1:], pc.cast(body, pa.binary())], names=["key", "doc_id", "row", "start", "n_tokens", "ids"]
            )

    schema = "key long, doc_id long, row long, start long, n_tokens long, ids binary"
    return keyed(docs, doc_id=id_col, text=text_col).mapInArrow(released(run), schema)


def cut(length: int, capacity: int) -> list[int]:
    """Sizes of the sequences for the last ``length`` ids, none padded: ``capacity`` or powers of two, from the largest."""
    sizes = [capacity] * (length // capacity)
    rest = length % capacity
    return sizes + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Packer:
    """Cuts documents that come one after another into sequences; rows of pieces."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.held: list[tuple] = []  # pieces of the open sequence: document, start, ids, its number of ids
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray, start: int, n: int) -> None:
        """The ids of a document of ``n`` from ``start`` on."""
        at = 0
        while at < len(ids):
            part = ids[at : at + self.capacity - self.size]
            self.held.append((doc_id, start + at, part, n))
            self.size += len(part)
            at += len(part)
            if self.size == self.capacity:
                self._close([self.capacity])

    def finish(self) -> None:
        self._close(cut(self.size, self.capacity))

    def _close(self, sizes: list[int]) -> None:
        """Rows of the held pieces, cut into sequences of the given sizes."""
        pieces = iter(self.held)
        doc_id, start, part, n = next(pieces, (None, 0, np.zeros(0, "<u4"), 0))
        for size in sizes:
            offset = 0
            while offset < size:
                if not len(part):
                    doc_id, start, part, n = next(pieces)
                now, part = part[: size - offset], part[size - offset :]
                self.rows.append((doc_id, start, len(now), zlib.crc32(now.tobytes()), n, self.sequence, offset, now))
                start += len(now)
                offset += len(now)
            self.sequence += 1
        self.held, self.size = [], 0


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 2048, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's ids, closed by ``end_id``, into sequences of ``capacity``.

    One row per piece of a document: doc_id, start (ids of the document before it), length,
    ids_crc32, doc_tokens, sequence_id, offset (in the sequence), and with ``ids`` the ids themselves.
    ``capacity`` is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    made = materialize(encoded(docs, tokenizer_file, end_id, id_col, text_col), "encoded")
    total = made.where("start = 0").agg(F.sum("n_tokens")).first()[0] or 0
    order = ["key", "doc_id", "row", "start"]
    dealt = made.repartitionByRange(-(-total // RANGE_TOKENS) or 1, *order).sortWithinPartitions(*order)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def taken() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            out = [pa.array(c, pa.int64()) for c in columns[:-1]]
            if ids:
                out.append(pa.array([c.tolist() for c in columns[-1]], pa.list_(pa.int32())))
            return pa.record_batch(out, names=names + ["ids"] * ids)

        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            for doc_id, start, n, data in zip(*[c.to_pylist() for c in columns], batch.column("ids"), strict=True):
                body = data.as_buffer()
                kind = "<u2" if body.size == 2 * min(n - start, PIECE_TOKENS) else "<u4"
                packer.add(doc_id, np.frombuffer(body, kind).astype("<u4"), start, n)
                if len(packer.rows) >= 10_000:
                    yield taken()
        packer.finish()
        if packer.rows:
            yield taken()

    schema = ", ".join(f"{n} long" for n in names) + (", ids array<int>" if ids else "")
    return dealt.select("doc_id", "start", "n_tokens", "ids").mapInArrow(released(run), schema)
