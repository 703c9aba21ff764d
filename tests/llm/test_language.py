"""Cross-parsing language identification: brute-force parsing, held-out accuracy, edges."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custval.llm import language as L
from custval.llm.common import table

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)
MODEL = (("de", ("der", "die", "und", "straße")), ("en", ("the", "and", "street")), ("xx", ("", "щи")))


def brute(word, words):
    text = " " + " ".join(words) + " "
    s, n = " " + word + " ", 0
    while s:
        k = len(s)
        while k > 1 and s[:k] not in text:
            k -= 1
        s, n = s[k:], n + 1
    return n


def test_phrases_against_brute_force():
    words = ["der", "dies", "andere", "xyz", "a", "strasse", "щ", "ééé", "theandstreet", "d" * 70]
    got = L.count_phrases(pa.array(words), MODEL)
    assert got.tolist() == [[brute(w, known) for _, known in MODEL] for w in words]


def test_automaton_holds_exactly_the_substrings():
    text = "abcbcabb"
    goto = L.suffix_automaton(text)
    found = set()
    walk = [(0, "")]
    while walk:
        state, s = walk.pop()
        found.add(s)
        walk += [(t, s + c) for c, t in goto[state].items()]
    assert found == {text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)}


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = L.label_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right >= 0.97


def test_edges(spark):
    rows = [(i, "the and street", "en", None) for i in range(8)] + [(i, "der die und", "de", "9") for i in range(8, 16)]
    rows += [(16, None, "en", None), (17, "", "de", None), (18, "123 !? ²", "de", None), (None, "The AND", None, "x")]
    rows += [(19, "und der " * 40_000, None, None), (20, "щ", None, None), (8, "der die und", "de", "9")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = L.label_languages(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (16, 17, 18)] == ["und"] * 3 and by[16].score == 0
    assert by[None].lang_pred == "en" and by[19].lang_pred == "de" and by[8].lang_pred == "de"
    assert by[20].lang_pred == "de" and abs(by[20].score - 0.5) < 1e-9  # nothing matches: the first language
    assert all(0 <= r.score <= 1 for r in got) and not by[None].held_out


def test_empty_and_unlabelled(spark):
    assert L.label_languages(spark.createDataFrame([], SCHEMA)).collect() == []
    got = L.label_languages(spark.createDataFrame([(1, "abc", None, None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_scripts_without_blanks(spark):
    def line(first, i):  # 30 of 40 words of two letters, marks between some and no blank
        return "".join(chr(first + 2 * w) + chr(first + 2 * w + 1) + ("、" if k % 25 == 24 else "") for k in range(30) for w in [(7 * i + k * k) % 40])

    rows = [(i, line(0x4E00, i), "zh", None) for i in range(40)] + [(100 + i, line(0xAC00, i), "ko", None) for i in range(40)]
    rows += [(200 + i, f"the and street word{i}", "en", None) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = dict(L.fit_languages(docs))
    assert set(model) == {"zh", "ko", "en"} and max(len(w) for words in model.values() for w in words) <= L.LONGEST_WORD
    got = {r.doc_id: r for r in L.label_languages(docs).collect()}
    assert all(got[d].lang_pred == lang and got[d].score > 0.5 for d, _, lang, _ in rows)


def test_many_words_are_learned(spark):
    rows = [(i, " ".join("w" + "abcdefghij"[k // 100 % 10] * 2 + "klmnopqrst"[k // 10 % 10] + "uvwxyzabcd"[k % 10] + "efgh"[k // 1000] for k in range(36 * i, 36 * i + 36)), "en", None) for i in range(100)]
    model = dict(L.fit_languages(spark.createDataFrame(rows, SCHEMA)))
    assert len(model["en"]) == 3600
    _, automata = L.tables(tuple(model.items()))
    assert sum(t.keys.nbytes + t.values.nbytes for t in automata) < 4 << 20


def chinese(rnd, n):
    return "".join(chr(rnd.randrange(0x4E00, 0x4E00 + 800)) for _ in range(n))


def test_long_words_against_brute_force(monkeypatch):
    """The two ways of parsing give the same counts; the words straddle the bound."""
    import random

    rnd = random.Random(3)
    words = tuple(sorted({chinese(rnd, rnd.randrange(1, 41)) for _ in range(60)}))
    model = (*MODEL, ("zh", words))
    text = ["".join(rnd.choice([*words, "щ", "the", "ы"]) for _ in range(40))[:n] for n in (1, 5, 99, 100, 101, 102, 400, 900)]
    text += ["d" * 300, "щ" * 301, "ab" * 150, "derdieund" * 40]
    want = [[brute(w, known) for _, known in model] for w in text]
    assert L.count_phrases(pa.array(text), model).tolist() == want
    for bound in (0, 10_000):
        monkeypatch.setattr(L, "STEPPED", bound)
        assert L.count_phrases(pa.array(text), model).tolist() == want


def test_a_megabyte_without_blanks_is_quick():
    import random
    import time

    rnd = random.Random(4)
    model = tuple((lang, tuple(sorted({chinese(rnd, 40) for _ in range(1500)}))) for lang in ("a", "b", "c", "d"))
    L.tables(model)
    sample = model[2][1]
    body = "".join(rnd.choice(sample)[rnd.randrange(20) :] for _ in range(12_000))
    block = pa.record_batch([pa.array([1, 2]), pa.array([body, "щ" * 500_000])], names=["doc_id", "text"])
    assert len(body.encode()) > 1_000_000
    began = time.process_time()
    got = L.predict(block, model)
    assert got.column("lang_pred").to_pylist()[0] == "c" and time.process_time() - began < 6
