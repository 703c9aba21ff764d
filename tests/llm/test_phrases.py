"""Collocations against counts of all phrases."""

import random
import re
import string
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custval.llm import phrases as X
from custval.llm.common import table

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType())]
)


def expected(rows, least=10, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    covered = {(lang, w[i : i + 2]) for (lang, w), a in found.items() if len(w) == 3 for i in (0, 1) if 100 * a >= 50 * counts[lang, w[i : i + 2]]}
    out = []
    for (lang, w), a in found.items():
        if (lang, w) not in covered:
            cuts = [(10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], totals[lang], score))
    result, rank = set(), Counter()
    for r in sorted(out, key=lambda r: (-r[6], -r[2], r[1].encode())):
        rank[r[0]] += 1
        if rank[r[0]] <= top:
            result.add((r[0], rank[r[0]], *r[1:]))
    return result


def collected(df):
    rows = df.collect()
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


def corpus():
    rnd = random.Random(4)
    words = ["the", "The", "of", "new", "york", "city", "a", "b", "é", "É", "漢字", "x y", "\x00", "it's", "a-b", "ſ", "😀"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", " \x1c ", "\x85"]
    rows = [("".join(rnd.choice(words) + rnd.choice([" "] * 12 + marks) for _ in range(rnd.randrange(60))), rnd.choice(["en", "de", None, "und", "a\nb", ""])) for _ in range(300)]
    rows += [(None, "en"), ("", None), (" \t.", "en"), ("the " * 30_000, "en"), ("one", "fr"), ("New York City " * 12, "fr")]
    return [(i, t, lang, "x") for i, (t, lang) in enumerate(rows)] + [(3, "New York", "en", None)] * 20


@pytest.mark.parametrize("groups", [None, 3000, 100])
def test_against_all_phrases(spark, monkeypatch, groups):
    """Whatever the budget: with small groups most prefixes are extended."""
    if groups:
        monkeypatch.setattr(X, "GROUP_SUFFIXES", groups)
        monkeypatch.setattr(X, "BLOCK_BYTES", 5000)
    rows = corpus()
    want = expected([r[1:3] for r in rows])
    assert collected(X.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want
    assert len({r[0] for r in want}) > 4


def test_first_of_each_language(spark):
    rows = corpus()
    got = collected(X.collocations(spark.createDataFrame(rows, SCHEMA), least=3, top=7))
    assert got == expected([r[1:3] for r in rows], 3, 7) and max(r[1] for r in got) == 7


def test_filled_filter_and_few_heavy_prefixes(spark, monkeypatch):
    """A filter too small for the words, and a bound on the extended prefixes, change nothing."""
    monkeypatch.setattr(X, "FILTER_BLOCKS", 1)
    monkeypatch.setattr(X, "MOST_HEAVY", 2)
    monkeypatch.setattr(X, "GROUP_SUFFIXES", 500)
    rows = corpus()
    assert collected(X.collocations(spark.createDataFrame(rows, SCHEMA))) == expected([r[1:3] for r in rows])


def test_whole_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert collected(X.collocations(docs)) == expected(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame(corpus()[:1], SCHEMA)
    for df in (docs.where(F.lit(False)), docs.withColumn("text", F.lit(None).cast("string"))):
        assert X.collocations(df).collect() == []


def test_hashes_do_not_depend_on_place():
    words = ["", "a", "b", "a\x00", "\x00a", "é", "a" * 1000]
    one = X.hashes(pa.array(words))
    two = X.hashes(pa.array(["zzz", *words[::-1]]))[1:][::-1]
    assert one.tolist() == two.tolist() and len(set(one.tolist())) == len(words)


def test_leaf_totals_and_exact_scores(spark):
    """Scores whose products pass 64 bits."""
    text = "p q r " * 40
    docs = spark.createDataFrame([(1, text, "en", "")], SCHEMA)
    assert collected(X.collocations(docs)) == expected([(text, "en")])
    big = spark.sql("SELECT 30000000000 AS a, 40000000000 AS l, 50000000000 AS r")
    row = big.selectExpr("(1000000BD * cast(a AS decimal(14,0)) * cast(a AS decimal(14,0))) div (cast(l AS decimal(14,0)) * cast(r AS decimal(14,0))) AS s").first()
    assert row.s == 10**6 * 30000000000**2 // (40000000000 * 50000000000)
