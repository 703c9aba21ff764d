"""The corpus pipeline against a plain Python version of its stages, and its edges."""

import base64
import hashlib
from collections import Counter

import public_tokenizers as P
import tiktoken
from pyspark.sql import types as T

import corpus_pipeline as C
from custval.llm import language as L
from custval.llm import mixing as M
from custval.llm.common import table
from tests.llm import test_secrets as secrets
from tests.llm import test_setsketch as near
from tests.llm.test_mixing import words

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("tag", T.StringType()),
    ]
)


def redacted(text):
    merged = []
    for a, _, b in sorted(secrets.base(text) + secrets.method(text)):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def test_stages_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}

    first = C.language_id(spark, docs, SF)
    found = {r.doc_id: r for r in L.identify(docs, L.fit_languages(docs.where(~L.held_out()))).collect()}
    one = {r.doc_id: r for r in first.collect()}
    assert set(one) == {d for d, f in found.items() if f.lang_pred != "und" and f.score > 0.25 + 1e-9}
    assert all(one[d].text == rows[d].text and one[d].lang == (rows[d].lang or found[d].lang_pred) for d in one)

    second = C.near_dedup(spark, first, SF)
    two = {r.doc_id: r for r in second.collect()}
    assert set(two) == {c for _, _, c in near.brute([(d, r.text) for d, r in one.items()])}

    third = C.remove_secrets(spark, second, SF)
    three = {r.doc_id: r for r in third.collect()}
    assert {d: r.text for d, r in three.items()} == {d: redacted(r.text) for d, r in two.items()}
    assert all(r.n_chars == len(r.text) for r in three.values())

    fourth = C.mix_sources(spark, third, SF)
    drawn = Counter(r.doc_id for r in fourth.collect())
    size = Counter()
    for r in three.values():
        size[r.source] += words(r.text)
    names = sorted(size)
    target = M.water_fill([size[s] for s in names], [C.WEIGHTS[i % 3] for i in range(len(names))], sum(size.values()), 3)
    longest = max(words(r.text) for r in three.values())
    for s, t in zip(names, target, strict=True):
        assert abs(sum(n * words(three[d].text) for d, n in drawn.items() if three[d].source == s) - t) <= 2 * longest
    assert set(drawn.values()) <= {1, 2, 3}

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = C.run(spark, SF).collect()
    assert Counter(r.doc_id for r in last) == drawn
    for r in last:
        assert r.ids == library.encode_ordinary(three[r.doc_id].text)
        assert r.decoded_sha256 == hashlib.sha256(three[r.doc_id].text.encode()).hexdigest()


def test_edges(spark):
    rows = [(i, f"the house and the {w} of the town stood here", "en", "a", 1, "x") for i, w in enumerate(["tree", "hill", "lake"] * 4)]
    rows += [(50, None, "en", None, None, None), (51, "", None, "b", 0, ""), (None, "token = abcdefghijklmnop1 the house", None, None, 3, "")]
    rows += [(60, "the house and the tree", None, "b", 2, "y")] * 2 + [(61, "the hill " * 30_000, "en", "b", 2, "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == C.COLUMNS
    left = docs.collect()
    assert {r.doc_id for r in left} <= {0, 1, 2, None, 60, 61}
    assert C.STAGES[-1][1](spark, docs, "").count() == len(left)
    assert all("abcdefghijklmnop1" not in r.text for r in left)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
