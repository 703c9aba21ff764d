"""Merge replay against the tiktoken library, and the exact round trip."""

import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import types as T

from custval.llm import bpe as B
from custval.llm.common import table

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())]
)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(got, text, library):
    ids = library.encode_ordinary(text or "")
    assert got.n_tokens == len(ids)
    assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_small_table(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id: r.text for r in docs.collect()}
    got = B.bpe_round_trip(docs, RANKS, P.PATTERN).collect()
    assert len(got) == len(want)
    for r in got:
        check(r, want[r.doc_id], library)


def test_edges(spark, library):
    rnd = random.Random(7)
    letters = "abcdeéèßñ漢字かな한글😀  \n\t\r\x0b\x1c\x85  '’0123²½,.!?#�́"
    texts = [None, "", " ", "\n\n ", "it's we'LL I'd", "a" * 50_000, " " * 3000 + "x", "<|endoftext|>", "漢字" * 2000, "x\x00y"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 80))) for _ in range(400)]
    texts += ["".join(rnd.choice("abt he inrs") for _ in range(200)) for _ in range(50)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], None)]
    got = B.bpe_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3), RANKS, P.PATTERN, ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        check(r, texts[r.doc_id], library)
        assert library.decode_bytes(r.ids) == (texts[r.doc_id] or "").encode()
    no_id = B.bpe_round_trip(spark.createDataFrame([(None, "ab", "")], SCHEMA), RANKS, P.PATTERN).collect()
    assert no_id[0].doc_id is None and no_id[0].n_tokens == len(library.encode_ordinary("ab"))


def test_replay_equals_lowest_rank_first():
    """Ranks in which a merge makes pairs of lower rank, against a direct loop."""
    rnd = random.Random(2)
    for _ in range(200):
        tokens = {bytes([b]) for b in range(256)} | {"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 6))).encode() for _ in range(14)}
        order = sorted(tokens)
        rnd.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        pieces = list({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 14))).encode() for _ in range(20)})
        got = B.Merges(ranks).replay(pieces)
        for piece, ids in zip(pieces, got, strict=True):
            parts = [piece] if piece in ranks else [bytes([b]) for b in piece]
            while True:
                pairs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
                if not pairs:
                    break
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert ids == [ranks[p] for p in parts], (piece, ranks)


def test_empty_table(spark):
    assert B.bpe_round_trip(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).collect() == []


def test_blanks_of_the_pattern():
    assert regex.findall(r"\s", "\x1c\x85 ") == ["\x85", " "]


def test_units_never_part_a_piece():
    rnd = random.Random(1)
    chars = ["a", "é", "字", " ", "  ", "\n", "\t", "\u00a0", "\u0085", "\u2003", "\u2028", "\u3000", "\u1680", "\u205f", "\u202f", "'", "s", ",", "1", "\x1c", "😀"]
    split = regex.compile(P.PATTERN)
    texts = [None, "", " ", "a b", " a", "b "] + ["".join(rnd.choice(chars) for _ in range(rnd.randrange(1, 30))) for _ in range(3000)]
    strings, offsets = B.units(pa.array(texts))
    strings = strings.to_pylist()
    for text, i, j in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert "".join(strings[i:j]) == (text or "")
        assert [p for u in strings[i:j] for p in split.findall(u)] == split.findall(text or ""), text


def test_forgetting_units_changes_nothing(spark, library, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 10)
    monkeypatch.setattr(B, "REMEMBERED_PAIRS", 5)
    encoder = B.Encoder(open(RANKS, "rb").read(), P.PATTERN)
    for text in ["some words and others", "other words again, some", "some", ""] * 3:
        tokens, at = encoder.block(pa.array([text, None, "x"]))
        assert tokens.tolist() == library.encode_ordinary(text) + library.encode_ordinary("x")
        assert at.tolist()[:3] == [0, len(tokens) - 1, len(tokens) - 1]
