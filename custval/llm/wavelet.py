"""Token ids in wavelet-matrix files.

A shard's token ids are stored as a wavelet matrix: one bit-plane per bit of the
largest id, from the highest, the tokens stably parted by each bit on the way
down.  With counts of ones every 512 bits (rank directory) the file answers, in
one step per plane and without unpacking the tokens: the token at a position
(``access``), how often a token occurs before a position (``rank``), and where
its k-th occurrence is (``select``).

Writing is three Spark steps: encode (one narrow pass), deal the ids out by
ranges of doc_id, and let each task cut its range into shards of about
``SHARD_TOKENS`` and write each as one compressed binary file image.  The images go
through Spark's Parquet writer (one row per shard), so that they reach any store
Spark can write, with its commit protocol for lost executors.  Memory is bounded
by a shard (a document longer than a shard is one by itself).

Defined results: a null text is empty (it holds only the end id); repeated rows and
equal ids are all stored, in the order of their ids' bytes; null ids come first; an
empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custval.llm.common import Known, blocks, gather, keyed, larger, released, rows_of, word_codes
from custval.llm.ranked import WordRanks
from custval.session import Scratch, materialize, materialized_root

#: Tokens of a shard, at about which a task starts the next one.
SHARD_TOKENS = 4 << 20
#: Text bytes whose distinct words are encoded together, and words kept for the next ones.
ENCODE_BYTES = 16 << 20
CACHED_WORDS = 1_500_000

#: Letters after which the tokenizer cuts off a comma or stop whatever else it does (lower-casing others may leave a mark).
PLAIN = r"[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]"

MAGIC = b"WVM1"
SUPER = 512  # bits between the counts of the rank directory
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Bit-planes of a token sequence, highest bit first, with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], directory: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.directory = n, planes, zeros, directory

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (tokens & tokens.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low = np.compress(~bit, tokens)  # several times faster than a mask on random bits
            zeros.append(len(low))
            tokens = np.concatenate([low, np.compress(bit, tokens)])
        return cls(len(tokens), planes, zeros, [cls.count_ones(p) for p in planes])

    @staticmethod
    def count_ones(plane: np.ndarray) -> np.ndarray:
        """Ones before every SUPER bits."""
        step = SUPER // 8
        padded = np.zeros(-(-max(len(plane), 1) // step) * step, np.uint8)
        padded[: len(plane)] = _ONES[plane]
        return np.concatenate([[0], np.cumsum(padded.reshape(-1, step).sum(axis=1, dtype=np.int64))]).astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, byte = i // SUPER, i // 8
        ones = int(self.directory[level][block]) + int(_ONES[self.planes[level][block * (SUPER // 8) : byte]].sum())
        return ones + (int(_ONES[self.planes[level][byte] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def _select(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        lo, hi = 0, self.n
        while lo < hi:  # the first i with more than k such bits before it
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid)
            lo, hi = (mid + 1, hi) if (ones if one else mid - ones) <= k else (lo, mid)
        return lo - 1

    def access(self, i: int) -> int:
        token = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i // 8]) >> i % 8 & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token * 2 + bit
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token among the first ``end`` stand after the last plane."""
        start, levels = 0, len(self.planes)
        if token >> levels:
            return 0, 0
        for level in range(levels):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (levels - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token among the first ``end`` positions."""
        start, end = self._range(token, end)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        start, end = self._range(token, self.n)
        if not 0 <= k < end - start:
            raise IndexError(f"token {token} occurs {end - start} times")
        at = start + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = at >= self.zeros[level]
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens, the partitions undone plane by plane."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            z = self.zeros[level]
            up[np.flatnonzero(~bit)] = out[:z]
            up[np.flatnonzero(bit)] = out[z:] | kind(1 << (len(self.planes) - 1 - level))
            out = up
        return out


def to_file(tokens: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The image of one shard: header, documents, then each plane (compressed) with its rank directory."""
    matrix = WaveletMatrix.build(tokens)
    null = np.packbits([d is None for d in doc_ids], bitorder="little")
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    sections = [ids.tobytes(), null.tobytes(), lengths.astype(np.int64).tobytes(), np.array(matrix.zeros, np.int64).tobytes()]
    sections += [part.tobytes() for pair in zip(matrix.planes, matrix.directory, strict=True) for part in pair]
    packed = [zstandard.ZstdCompressor(level=1).compress(s) for s in sections]
    head = struct.pack("<4sqqi", MAGIC, matrix.n, len(doc_ids), len(matrix.planes))
    return head + b"".join(struct.pack("<q", len(p)) + p for p in packed)


def from_file(image: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(matrix, document ids, tokens of each document) of a shard's image."""
    magic, n, docs, levels = struct.unpack_from("<4sqqi", image)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    at, parts = struct.calcsize("<4sqqi"), []
    while at < len(image):
        (size,) = struct.unpack_from("<q", image, at)
        parts.append(zstandard.ZstdDecompressor().decompress(memoryview(image)[at + 8 : at + 8 + size]))
        at += 8 + size
    ids = np.frombuffer(parts[0], np.int64).tolist()
    null = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=docs, bitorder="little") if docs else []
    ids = [None if gone else d for d, gone in zip(ids, null, strict=True)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[4 : 4 + 2 * levels : 2]]
    directory = [np.frombuffer(p, np.uint32) for p in parts[5 : 5 + 2 * levels : 2]]
    return WaveletMatrix(n, planes, np.frombuffer(parts[3], np.int64).tolist(), directory), ids, np.frombuffer(parts[2], np.int64)


class WordEncoder:
    """Encodes texts whose tokenizer never looks across ASCII blanks, each distinct word once.

    A lower-cased word (unless it may hold a special token) and a final comma or
    stop after a plain letter are encoded by themselves: the tokenizer lower-cases
    and splits there.  Words of plain letters are single pieces for the tokenizer, and
    encoded by ranks; all others go to the library joined by blanks, and its offsets tell
    them apart.  ``tests/llm/test_wavelet.py`` compares with whole texts.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        self.ranks = WordRanks(data)
        self.known = Known(CACHED_WORDS)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        found = self.library.encode(" ".join(words), add_special_tokens=False)
        begins = np.array([o[0] for o in found.offsets], np.int64)
        cuts = np.searchsorted(begins, np.cumsum([len(w) + 1 for w in words]))
        return np.array(found.ids, np.uint32), np.diff(cuts, prepend=0)

    def learn(self, new: pa.Array, step: int = 500) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(new, f"^{PLAIN}+$").to_numpy(zero_copy_only=False).astype(bool)
        quick, slow = np.flatnonzero(plain), np.flatnonzero(~plain)
        size = np.zeros(len(new), np.int64)
        ids, size[quick] = self.ranks.encode(new.take(pa.array(quick)))
        parts, words = [ids], new.take(pa.array(slow))
        for i in range(0, len(slow), step):
            ids, size[slow[i : i + step]] = self._encode(words[i : i + step].to_pylist())
            parts.append(ids)
        order = np.concatenate([quick, slow])  # as the ids now stand
        flat, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum(size[order])])
        back = np.argsort(order)
        return gather(flat, ends, back), size

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, each closed by ``end_id``, and their offsets."""
        codes, offsets, words = word_codes(texts)
        lower = pc.if_else(pc.match_substring(words, "<"), words, pc.ascii_lower(words))
        comma = pc.match_substring_regex(lower, PLAIN + ",$").to_numpy(zero_copy_only=False).astype(bool)
        stop = pc.match_substring_regex(lower, PLAIN + "[.]$").to_numpy(zero_copy_only=False).astype(bool)
        stems = pc.if_else(pa.array(comma | stop), pc.utf8_slice_codeunits(lower, 0, -1), lower)
        marks = pa.array(["", ",", "."])
        distinct = pc.unique(pa.concat_arrays([marks, stems]))  # the marks come first
        number = self.known.numbers(distinct, self.learn)
        stem = number[pc.index_in(stems, distinct).to_numpy(zero_copy_only=False)] if len(stems) else codes
        tail = number[np.where(comma, 1, np.where(stop, 2, 0))]
        flat, at = self.known.flat, self.known.at
        size = np.diff(at)
        stem_size, tail_size = size[stem][codes], size[tail][codes]
        done = np.concatenate([[0], np.cumsum(stem_size + tail_size)])
        out_offsets = done[offsets] + np.arange(len(offsets))
        out = np.full(int(out_offsets[-1]), end_id, np.uint32)
        begin = done[:-1] + rows_of(offsets)  # one end id for each text before
        for of, n, place in ((stem, stem_size, begin), (tail, tail_size, begin + stem_size)):
            some = np.flatnonzero(n)
            n, place = n[some], place[some]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(place, n) + inner] = flat[np.repeat(at[of][codes[some]], n) + inner]
        return out, out_offsets


@lru_cache(maxsize=1)
def _encoder(data: bytes) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that frequent words stay known."""
    return WordEncoder(data)


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write shards in ascending id order below ``path`` (columns: part, seq, n_tokens, image)."""
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a fixed file of under 2 MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for block in blocks(larger(batches, limit=ENCODE_BYTES), limit=ENCODE_BYTES):
            ids, at = encoder.texts(block.column("text"), end_id)
            narrow = ids.astype(np.uint16) if encoder.library.get_vocab_size() <= 1 << 16 else ids
            width = narrow.itemsize
            body = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * width), pa.py_buffer(narrow)])
            yield pa.record_batch(
                [block.column("doc_id"), pa.array(np.diff(at)), pc.cast(body, pa.binary())], names=["doc_id", "n_tokens", "ids"]
            )

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def image() -> pa.RecordBatch:
            width = sum(map(len, ids)) // max(1, sum(sizes))
            tokens = np.frombuffer(b"".join(ids), np.uint16 if width == 2 else np.uint32)
            row = [[part], [seq], [len(tokens)], [to_file(tokens, names, np.array(sizes, np.int64))]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "seq", "n_tokens", "image"])

        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")], strict=True)
            for doc_id, n, data in rows:
                if names and sum(sizes) + n > SHARD_TOKENS:
                    yield image()
                    seq += 1
                    ids, names, sizes = [], [], []
                names.append(doc_id)
                sizes.append(n)
                ids.append(data)
        if names:
            yield image()

    rows = keyed(docs, doc_id=id_col, text=text_col)
    encoded = materialize(rows.mapInArrow(released(encode), "doc_id long, n_tokens long, ids binary"), "encoded")
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    order = ["doc_id", F.xxhash64("ids"), "ids"]
    dealt = encoded.repartitionByRange(-(-total // SHARD_TOKENS) or 1, *order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(released(shard), "part int, seq int, n_tokens long, image binary").write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """Every stored document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, in file order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*[batch.column(c) for c in ("part", "seq", "image")], strict=True):
                matrix, ids, sizes = from_file(data.as_buffer())
                tokens = matrix.tokens().astype("<u4").tobytes()
                end = np.cumsum(sizes)
                start = end - sizes
                crc = [zlib.crc32(memoryview(tokens)[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                n = len(ids)
                yield pa.record_batch(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(ids, pa.int64())]
                    + [pa.array(x, pa.int64()) for x in (start, sizes, crc)],
                    names=["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.parquet(path)
    # the tokens before a shard: those of the parts before its own (one row per part), and those before it in its part
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offset = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner")).join(parts, "part")
    offset = offset.select("part", "seq", (F.col("inner") + F.col("before")).alias("base"))
    docs = shards.select("part", "seq", "image").mapInArrow(released(read), "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return docs.join(offset, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write the token files of ``docs`` to the shared checkpoint folder and read them back."""
    spark = docs.sparkSession
    path = f"{materialized_root(spark)}/tokens-{os.urandom(8).hex()}"
    Scratch.note(path)
    write_tokens(docs, tokenizer_file, path, end_id)
    return read_tokens(spark, path)
