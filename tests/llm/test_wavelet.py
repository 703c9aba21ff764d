"""Wavelet-matrix token files: against the library on whole texts, and rank/select against lists."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from custval.llm import wavelet as V
from custval.llm.common import table

FILE = P.path("word_bpe_49k.json")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType())]
)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def expected(rows, library):
    """rows: (doc_id, text), in any order."""
    made = []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        made.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    return made


def compare(df, rows, library):
    got = df.collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(expected(rows, library), key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_whole_small_table(spark, library, monkeypatch):
    monkeypatch.setattr(V, "SHARD_TOKENS", 50_000)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compare(V.token_files(docs, FILE, 2), rows, library)


def test_edges(spark, library):
    rnd = random.Random(4)
    letters = "abcABCÉéßİıſKàñ漢字가́̈'’sS0123²½<|>endoftext.,!?-_ \n\t\x1c\x85  😀"
    texts = [None, "", " \n", "a", "It's WE'LL, x.", "<|endoftext|>", "a<|endoftext|>.b", "<|ENDOFTEXT|>.", "é. É, à.", "x" * 40_000]
    texts += ["k,. ,. a.. a,, 1. 1, ça. ́, a b̈.", "Straße. ΣΑΣ, ΑΣ. İ. word,\x85word."]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 120))) for _ in range(500)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "a", None), (3, "b", None), (None, "z", ""), (None, None, "")]
    compare(V.token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), FILE, 2), [r[:2] for r in rows], library)


def test_empty_table(spark):
    assert V.token_files(spark.createDataFrame([], SCHEMA), FILE, 2).collect() == []


def test_rank_select_access():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (5, 2), (700, 4), (3000, 49_408), (1200, 300)):
        tokens = rng.integers(0, top, n).astype(np.uint32)
        matrix, ids, sizes = V.from_file(V.to_file(tokens, [4, None], np.array([n, 0])))
        assert ids == [4, None] and sizes.tolist() == [n, 0]
        assert (matrix.tokens() == tokens).all()
        for i in rng.integers(0, max(n, 1), 40)[: n and 40]:
            t = int(tokens[i])
            assert matrix.access(int(i)) == t
            where = np.flatnonzero(tokens == t)
            assert matrix.count(t) == len(where)
            assert matrix.rank(t, int(i)) == (where < i).sum()
            k = int(rng.integers(len(where)))
            assert matrix.select(t, k) == where[k]
        assert matrix.count(top + 70_000) == 0
        with pytest.raises(IndexError):
            matrix.select(top + 70_000, 0)


def test_words_by_ranks_equal_the_library(library):
    """Every plain word of the vocabulary, their joins, and random letters."""
    rnd = random.Random(3)
    plain = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    known = [w for w in (t.removesuffix("</w>") for t in library.get_vocab()) if w.isascii() and w.isalpha() and w.islower()]
    words = known + ["".join(rnd.sample(known, 2)) for _ in range(20_000)]
    words += ["".join(rnd.choice(plain) for _ in range(rnd.randrange(1, 25))) for _ in range(20_000)]
    words += ["".join(rnd.choice("aen") for _ in range(rnd.randrange(1, 60))) for _ in range(5000)] + ["z" * 5000]
    ids, size = V.WordRanks(open(FILE, "rb").read()).encode(V.pa.array(words))
    want = [x.ids for x in library.encode_batch(words, add_special_tokens=False)]
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
