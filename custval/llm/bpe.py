"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its texts block by block.  Texts are cut before every single blank
between two other characters; the split pattern never joins what such a cut parts,
so equal units give equal pieces, and only units that are new to the task's Python
worker go on.  Their distinct pieces are laid out once, byte by byte, in one array of
tokens.  An inverted index holds, for every merged token that some neighbouring
pair would give, the positions of those pairs.  The merges are then replayed over
all these words in rank order: all positions of the lowest rank are merged, left to
right, and only their two new neighbour pairs enter the index.  Texts are put
together from their units' ids.

The work is one narrow pass (no shuffle, nothing gathered); memory is bounded by
the block and by ``REMEMBERED`` units.  The rank file is a parameter and is read by
the driver; Spark broadcasts it (its size is fixed, under 1 MB).

Defined results: a null text is empty (no ids); text is taken whole; repeated rows
give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from custval.llm.common import Known, blocks, gather, keyed, released, text_bytes

#: Text bytes that are taken together, and distinct pieces that are merged together (their arrays stay in the cache).
REPLAY_BYTES = 4 << 20
REPLAY_PIECES = 4096
#: Units whose ids a Python worker remembers, and token pairs whose rank it does.
REMEMBERED = 400_000
REMEMBERED_PAIRS = 100_000

#: White space beyond ASCII, as UTF-8: two bytes, or three with the last in a range.  Fixed values.
_WIDE_BLANKS = ((b"\xc2", 0x85, 0x85), (b"\xc2", 0xA0, 0xA0), (b"\xe1\x9a", 0x80, 0x80), (b"\xe2\x80", 0x80, 0x8A),
                (b"\xe2\x80", 0xA8, 0xA9), (b"\xe2\x80", 0xAF, 0xAF), (b"\xe2\x81", 0x9F, 0x9F), (b"\xe3\x80", 0x80, 0x80))


def blank_after(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character starts at each of the positions (which leave two bytes behind them)."""
    byte = body[at]
    out = (byte == 32) | ((byte >= 9) & (byte <= 13))
    for head, low, high in _WIDE_BLANKS:
        hit = byte == head[0]
        for i in range(1, len(head)):
            hit &= body[at + i] == head[i]
        last = body[at + len(head)]
        out |= hit & (last >= low) & (last <= high)
    return out


def blank_before(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character ends right before each of the positions (which have three bytes before them)."""
    byte = body[at - 1]
    out = (byte == 32) | ((byte >= 9) & (byte <= 13))
    for head, low, high in _WIDE_BLANKS:
        hit = (byte >= low) & (byte <= high)
        for i in range(len(head)):
            hit &= body[at - 1 - len(head) + i] == head[i]
        out |= hit
    return out


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before every blank (0x20) that stands alone between other characters: the units, row offsets."""
    body, at = text_bytes(texts)
    padded = np.concatenate([np.zeros(3, np.uint8), body, np.zeros(3, np.uint8)])
    blank = np.flatnonzero(body == 32)
    first = np.zeros(len(body) + 1, bool)
    first[at] = True  # positions where a text starts or the last one ends
    blank = blank[~first[blank] & ~first[blank + 1]]
    blank = blank[~blank_before(padded, blank + 3)]
    cuts = blank[~blank_after(padded, blank + 4)]
    starts = np.sort(np.concatenate([at[:-1][np.diff(at) > 0], cuts]))
    offsets = np.append(starts, len(body))
    strings = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
    return strings, np.searchsorted(starts, at)


@lru_cache(maxsize=1)
def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's tokens: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Merges:
    """The ranks, their inverse, and the rank that each pair of neighbouring tokens would merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.texts = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks.get(bytes([b]), -2 - b) for b in range(256)], np.int64)
        self.of_bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        # rank of the merged pair by its left and by its right token (-1: none), as far as met
        self.followed: dict[int, dict[int, int]] = {}
        self.preceded: dict[int, dict[int, int]] = {}
        self.met = 0

    def pair(self, a: int, b: int) -> int:
        """Rank of the merged pair, -1 if there is none; remembered under both tokens."""
        if self.met > REMEMBERED_PAIRS:
            for kept in (*self.followed.values(), *self.preceded.values()):
                kept.clear()
            self.met = 0
        self.met += 1
        r = self.ranks.get(self.texts[a] + self.texts[b], -1)
        self.followed.setdefault(a, {})[b] = r
        self.preceded.setdefault(b, {})[a] = r
        return r

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of every piece."""
        out: list[list[int]] = [[]] * len(pieces)
        rest: list[int] = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is None:
                rest.append(i)
            else:
                out[i] = [whole]
        # all other pieces in one array, an end mark (-1) after each
        size = np.array([len(pieces[i]) for i in rest], np.int64)
        raw = np.frombuffer(b"".join([pieces[i] + b"\0" for i in rest]), np.uint8)
        ends = np.cumsum(size + 1) - 1
        tokens = self.byte[raw]
        tokens[ends] = -1
        n = len(tokens)
        first = np.full(n, -1, np.int64)  # rank that the pair starting at each position merges to
        index: dict[int, list[int]] = {}
        if n:
            if (tokens < -1).any():
                raise ValueError("the rank file lacks a single byte")
            first[:-1] = self.of_bytes[raw[:-1], raw[1:]]
            first[ends] = -1
            first[ends - 1] = -1
            at = np.flatnonzero(first >= 0)
            at = at[np.argsort(first[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(first[at])) + 1):
                if len(part):
                    index[int(first[part[0]])] = part.tolist()
        token, merges_to = tokens.tolist(), first.tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank)
            places.sort()
            right = self.followed.setdefault(rank, {})
            left_of = self.preceded.setdefault(rank, {})
            lower = False
            for done, at in enumerate(places):
                if merges_to[at] != rank:
                    continue  # a neighbour has merged meanwhile
                nxt = after[at]
                far = after[nxt]
                token[at] = rank
                after[at] = far
                before[far] = at
                token[nxt] = merges_to[nxt] = -1
                b = token[far]
                if b >= 0:
                    r = right.get(b)
                    if r is None:
                        r = self.pair(rank, b)
                    merges_to[at] = r
                    if r >= 0:
                        lower = r < rank
                        if (waiting := index.get(r)) is None:
                            index[r] = [at]
                            heapq.heappush(queue, r)
                        else:
                            waiting.append(at)
                else:
                    merges_to[at] = -1
                left = before[at]
                if left >= 0 and (a := token[left]) >= 0:
                    r = left_of.get(a)
                    if r is None:
                        r = self.pair(a, rank)
                    merges_to[left] = r
                    if r >= 0:
                        lower = lower or r < rank
                        if (waiting := index.get(r)) is None:
                            index[r] = [left]
                            heapq.heappush(queue, r)
                        else:
                            waiting.append(left)
                if lower:  # a pair of lower rank goes first; the other places wait for their turn
                    if rest_places := places[done + 1 :]:
                        if rank in index:
                            index[rank] += rest_places
                        else:
                            index[rank] = rest_places
                            heapq.heappush(queue, rank)
                    break
        left_over = np.array(token, np.int64)
        kept = left_over >= 0
        flat = left_over[kept].tolist()
        upto = np.concatenate([[0], np.cumsum(kept)])
        stops = upto[ends].tolist()
        starts = upto[ends - size].tolist()
        for i, start, stop in zip(rest, starts, stops, strict=True):
            out[i] = flat[start:stop]
        return out


class Encoder:
    """Ids, their decimal text and their bytes for every unit met so far."""

    def __init__(self, data: bytes, pattern: str):
        self.merges = Merges(read_ranks(data))
        self.split = regex.compile(pattern)
        self.known = Known(REMEMBERED)
        most = max(self.merges.texts, default=0) + 1
        self.decimal = pa.array([b"%d," % i for i in range(most)], pa.large_binary())
        self.decoded = pa.array([self.merges.texts.get(i, b"") for i in range(most)], pa.large_binary())

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        split, setdefault = self.split.findall, number.setdefault
        rows = [[setdefault(p, len(number)) for p in split(unit)] for unit in new.to_pylist()]
        pieces = [p.encode() for p in number]
        ids = [x for i in range(0, len(pieces), REPLAY_PIECES) for x in self.merges.replay(pieces[i : i + REPLAY_PIECES])]
        flat = [t for row in rows for p in row for t in ids[p]]
        return np.array(flat, np.uint32), np.array([sum([len(ids[p]) for p in row]) for row in rows], np.int64)

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a block of texts, one after another, and the offsets of the texts."""
        strings, offsets = units(texts)
        coded = strings.dictionary_encode()
        flat, at = self.known.of(self.known.numbers(coded.dictionary, self.learn))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(np.diff(at)[codes])])
        return gather(flat, at, codes), upto[offsets]


@lru_cache(maxsize=1)
def _encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that frequent units stay known."""
    return Encoder(data, pattern)


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode every text and decode the ids again.

    One row per document: doc_id, n_tokens, ids_sha256 (hex digest of the decimal
    ids joined by commas), decoded_sha256 (hex digest of the decoded bytes); with
    ``ids`` also the token ids themselves.  ``rank_file`` is a local path that the
    driver can read.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for block in blocks(batches, limit=REPLAY_BYTES):
            tokens, at = encoder.block(block.column("text"))
            columns = [
                block.column("doc_id"),
                pa.array(np.diff(at), pa.int64()),
                _digests(encoder.decimal, tokens, at, 1),  # without the last comma
                _digests(encoder.decoded, tokens, at, 0),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.astype(np.int32))))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return keyed(docs, doc_id=id_col, text=text_col).mapInArrow(released(run), schema)


def _digests(strings: pa.Array, tokens: np.ndarray, at: np.ndarray, less: int) -> pa.Array:
    """SHA-256 of each row's tokens' strings, one after another, without the last ``less`` bytes."""
    joined = strings.take(pa.array(tokens))
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)[at]
    data = memoryview(joined.buffers()[2] or b"")
    rows = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    return pa.array([hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in rows])
