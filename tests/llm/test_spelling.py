"""Spelling variants against all pairs of words."""

import random
import re
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custval.llm import spelling as S
from custval.llm.common import table

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType())]
)
WORDS = "word string, n long"


def counted(rows, least=7, occurrences=2, typo=31):
    made = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                made[run] += 1
    return {w: n for w, n in made.items() if n >= occurrences}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, ratio=10):
    out = {}
    for w, n in words.items():
        others = [(-m, o) for o, m in words.items() if near(w, o)]
        most, other = min(others, default=(0, None))
        form = other if others and -most >= ratio * n else None
        out[w] = [form, w, n, len(others), -most if form else None]
    for w, row in out.items():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
    return {(w, *row) for w, row in out.items()}


def collected(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def vocabulary(seed, count, letters, sizes):
    rnd = random.Random(seed)
    made = set()
    while len(made) < count:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice(sizes)))
        made.add(w)
        for _ in range(rnd.randrange(4)):  # edits of edits
            i = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:]])
            made.add(w)
    return {w: int(10 ** rnd.uniform(0.4, 5)) for w in made if w}


@pytest.mark.parametrize(
    "words",
    [
        vocabulary(1, 300, "abcdeé", [7, 8, 9]),
        vocabulary(2, 60, "ab", [1, 2, 3, 4, 5]),
        vocabulary(3, 40, "ÀÿzA漢😀", [1, 2, 30, 31]),
        {"aaaaaaa": 1000, "aaaaaab": 100, "aaaaabb": 10, "aaaabbb": 2, "aaaaaac": 1000, "aaaaaad": 7},
    ],
)
def test_against_all_pairs(spark, words):
    assert collected(S.spelling_variants(spark.createDataFrame(list(words.items()), WORDS).repartition(3))) == grouped(words)


def test_ranges_of_blocks(spark, monkeypatch):
    """Filters beyond the bound are probed range by range, with the same result."""
    monkeypatch.setattr(S, "FILTER_BYTES", 8 * 40)
    monkeypatch.setattr(S, "PROBED", 64)
    words = vocabulary(5, 200, "abcdeé", [7, 8, 9])
    assert sum(S.Filters(Counter(map(len, words))).blocks.values()) > 40
    assert collected(S.spelling_variants(spark.createDataFrame(list(words.items()), WORDS))) == grouped(words)


def test_very_long_words(spark):
    long = "".join(random.Random(7).choice("acgt") for _ in range(30_000))
    words = {long: 1000, long[:-1]: 100, long[:-1] + "x": 2, "z" * 20_000: 5, "z" * 20_001: 60}
    got = {r[0]: r[1:] for r in collected(S.spelling_variants(spark.createDataFrame(list(words.items()), WORDS)))}
    assert got[long[:-1]][:2] == (long, long) and got[long[:-1] + "x"][:2] == (long, long) and got["z" * 20_000][0] == "z" * 20_001


def test_words_of_texts(spark):
    rnd = random.Random(8)
    pieces = ["variant", "Variant", "VARIÀNT", "variants", "x", "÷×Ðøabcd", "abcdefgh", " ", "-", "1", "ß", "ſ", "İ", "\n"]
    rows = [(rnd.choice([i, None]), rnd.choice(["".join(rnd.choice(pieces) for _ in range(30)), None, "", "e" * 50_000]), "x") for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:9], SCHEMA)
    want = counted([r[:2] for r in rows + rows[:9]])
    got = S.word_counts(docs).collect()
    assert {r.word: r.n for r in got} == want and len(got) == len(want)
    plain = S.word_counts(docs, least=1, occurrences=1, typo=0).collect()
    assert {r.word: r.n for r in plain} == counted([r[:2] for r in rows + rows[:9]], 1, 1, 0)


def test_whole_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    words = counted([(r.doc_id, r.text) for r in docs.collect()])
    assert collected(S.spelling_variants(S.word_counts(docs))) == grouped(words)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "short words", "x")], SCHEMA)
    for df in (docs, docs.where(F.lit(False))):
        assert S.spelling_variants(S.word_counts(df)).collect() == []


def test_filters_miss_nothing():
    import numpy as np
    import pyarrow as pa

    words = vocabulary(9, 3000, "abcdefgh", [7, 8, 9])
    filters = S.Filters(Counter(map(len, words)))
    blocks, bits = filters.entries(pa.array(list(words)))
    held = np.zeros(filters.total, np.uint64)
    np.bitwise_or.at(held, blocks, bits)
    filters.load(0, np.arange(filters.total), held.view(np.int64), filters.total)
    found = {(list(words)[a], e) for at, edits in filters.neighbours(pa.array(list(words)), np.arange(97, 105, dtype=np.uint32)) for a, e in zip(at, edits, strict=True)}
    true = {(a, e) for a, e in found if e in words}
    some = random.Random(1).sample(list(words), 200)
    for a in some:
        for b in words:
            if near(a, b) and (len(b) < len(a) or (len(a) == len(b) and a < b)):
                assert (a, b) in found
    assert len(found) - len(true) < 3 * len(words)  # few false ones
