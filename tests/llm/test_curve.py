"""Packing along the Hilbert curve: against the library on whole texts, and the curve against its definition."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from custval.llm import curve as C
from custval.llm import ranked as R
from custval.llm.common import table

FILE = P.path("byte_bpe_50k.json")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())]
)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def check(pieces, docs, library, capacity=2048):
    """Pieces (with ids) hold every document once, in sequences without gaps that are full or a power of two."""
    got = pieces.collect()
    sequences = {}
    for r in got:
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
    # documents put together again, as a bag: ids may repeat
    whole, open_ = [], {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            open_[r.doc_id] = []
        assert r.start == len(open_[r.doc_id])
        open_[r.doc_id] += r.ids
        if len(open_[r.doc_id]) == r.doc_tokens:
            whole.append((r.doc_id, tuple(open_[r.doc_id])))
    assert sum(r.length for r in got) == sum(len(x) for _, x in whole)
    want = [(d, (*library.encode(t or "", add_special_tokens=False).ids, 1)) for d, t in docs]
    assert sorted(whole, key=str) == sorted(want, key=str)
    return got


def test_whole_small_table(spark, library, monkeypatch):
    monkeypatch.setattr(C, "RANGE_TOKENS", 100_000)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(C.pack(docs, FILE, 1, ids=True), rows, library)


def test_edges(spark, library):
    rnd = random.Random(4)
    letters = "abcABCÉéßİıſ漢字가́'’sS012²<|>endoftext.,!?-_ \n\t\x1c\x85　  😀"
    texts = [None, "", " \n", "a", "It's WE'LL  x.", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x" * 400_000, " " * 100_000, "漢字" * 50_000]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 120))) for _ in range(500)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "z", "")]
    check(C.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), FILE, 1, ids=True), [r[:2] for r in rows], library)
    check(C.pack(spark.createDataFrame(rows, SCHEMA), FILE, 1, capacity=1, ids=True), [r[:2] for r in rows], library, 1)


def test_copies_spread_over_tasks(spark, library, monkeypatch):
    """One text and id in most rows: the ranges cut through it."""
    monkeypatch.setattr(C, "RANGE_TOKENS", 2000)
    rows = [(7, "the same words again and again", "x")] * 2000 + [(i, f"other {i}", "x") for i in range(100)]
    got = C.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), FILE, 1).collect()
    total = sum(r.length for r in got)
    parts = {}
    for r in got:
        parts[r.sequence_id >> 40] = parts.get(r.sequence_id >> 40, 0) + r.length
    assert total == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert len(parts) >= total // 4000 and max(parts.values()) < 6000


def test_empty_table(spark):
    assert C.pack(spark.createDataFrame([], SCHEMA), FILE, 1).collect() == []
    with pytest.raises(ValueError):
        C.pack(spark.createDataFrame([], SCHEMA), FILE, 1, capacity=1000)


@pytest.mark.parametrize(("axes", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_steps(axes, bits):
    """The keys number all cells, and cells of following keys touch."""
    points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = C.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_are_alike(spark, monkeypatch):
    """Following documents are more alike than any two: cosine of the hashed vectors, on the whole small table."""
    monkeypatch.setattr(C, "PIECE_TOKENS", 1 << 30)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = C.encoded(docs, FILE, 1).orderBy("key", "doc_id").collect()
    assert all(r.start == 0 for r in rows)
    ids = [np.frombuffer(r.ids, "<u2")[:-1] for r in rows]
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    v = C.Projector(50_257).vectors(np.concatenate(ids), at)
    follow = (v[1:] * v[:-1]).sum(axis=1).mean()
    anyone = (v @ v.T)[np.triu_indices(len(v), 1)].mean()
    assert follow > anyone + 0.1


def test_ranks_equal_the_library(library):
    encoding = R.byte_level(open(FILE, "rb").read())
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x20, 0x300), rnd.randrange(0x300, 0xD7FF), rnd.randrange(0x1F000, 0x20000)])) for _ in range(rnd.randrange(1, 40)))
        assert encoding.encode_to_numpy(text, allowed_special="all").tolist() == library.encode(text, add_special_tokens=False).ids


def test_plan_has_one_exchange_of_documents(spark, capsys):
    docs = table(spark, "/root/testdata/sf0.001", "documents").withColumn("key", F.lit(1))
    C.pack(docs, FILE, 1).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_long_documents_are_dealt_in_pieces(spark, library, monkeypatch):
    """Ranges of few rows hold few tokens, whatever the documents' lengths."""
    monkeypatch.setattr(C, "PIECE_TOKENS", 64)
    monkeypatch.setattr(C, "RANGE_TOKENS", 2000)
    rnd = random.Random(8)
    words = ["alpha", "beta", " gamma", "delta.", "漢字"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 60, 64, 700, 3000]))), "x") for i in range(40)]
    got = check(C.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), FILE, 1, ids=True), [r[:2] for r in rows], library)
    parts = {}
    for r in got:
        parts[r.sequence_id >> 40] = parts.get(r.sequence_id >> 40, 0) + r.length
    assert len(parts) > 8 and max(parts.values()) < 3 * sum(parts.values()) / len(parts)
