"""SetSketch grouping against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from custval.llm import setsketch as S
from custval.llm.common import table
from custval.llm.graph import components

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType())]
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def compare(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_whole_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compare(S.setsketch_groups(docs), rows)


def test_edges_and_chains(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(S, "CHUNK", 8)  # many chunks for the large group
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = [(None, "A b c d"), (5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "one\x1ctwo x y")]
    rows += [(20, "p q r s t"), (20, "p q r s t"), (21, "P q\tr s\nt"), (None, "p q r s t"), (22, "long " * 30_000)]
    chain = list(base)
    for i in range(60):  # neighbours are near, the ends are far apart
        rows.append((100 + i, " ".join(chain)))
        chain[(2 * i) % 120] = f"new{i}"
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(120)] = f"z{rnd.randrange(50)}"
        rows.append((1000 - i, " ".join(words)))
    data = [(d, t, "clash") for d, t in rows]
    compare(S.setsketch_groups(spark.createDataFrame(data, SCHEMA).repartition(4)), rows)


def test_empty_table(spark):
    assert S.setsketch_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        a = np.unique(rng.integers(0, 2**64, 4000, np.uint64))
        keep = int(len(a) * share)
        b = np.unique(np.concatenate([a[:keep], rng.integers(0, 2**64, 4000 - keep, np.uint64)]))
        ra, rb, rab = S.registers([a, b, np.union1d(a, b)])
        assert (np.maximum(ra, rb) == rab).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        equal, larger = np.array([(ra == rb).sum()]), np.array([(ra > rb).sum()])
        best, _ = S.joint_estimate(equal, larger, S.REGISTERS - equal - larger, np.array([len(a) * 1.0]), np.array([len(b) * 1.0]))
        assert abs(best[0] - true) < 0.2


def test_null_texts_block():
    assert [len(s) for s in S.shingle_sets(pa.array([None, "", "a b c d", "a"]))] == [0, 0, 2, 1]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (4, 4), (3, 1), (20, 10), (30, 10), (30, 25), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, 25: 10, 30: 10}


def test_near_copies_in_different_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1)  # every member of a bucket is dealt at random among as many chunks
    rnd = random.Random(5)
    rows = []
    for p in range(6):
        passage = [f"p{p}_{i}" for i in range(120)]
        for i in range(40):  # long texts that hold the passage and are far from each other
            rows.append((1000 * p + 10 + i, " ".join(passage + [f"t{rnd.randrange(10**9)}" for _ in range(90)])))
        rows += [(1000 * p + i, " ".join(passage + [f"e{p}_{i}_{k}" for k in range(8)])) for i in range(2)]
    compare(S.setsketch_groups(spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA).repartition(4)), rows)


def brute_of(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def test_five_words_and_four_fifths(spark):
    """The rule of callers without a contract: a 100-word text and one with 20 more words are near, by 96 of 116 shingles."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(100)]
    rows = [(0, " ".join(base)), (1, " ".join(base + [rnd.choice(words) for _ in range(20)])), (2, " ".join(base + [rnd.choice(words) for _ in range(30)]))]
    rows += [(3, "a b c d"), (4, "A b c d"), (5, "a b c d e"), (6, ""), (7, "a")]
    for i in range(60):  # copies with more and more words replaced, on both sides of the threshold
        w = [rnd.choice(words) for _ in range(rnd.randrange(60, 200))]
        rows.append((100 + 10 * i, " ".join(w)))
        for k in range(1, 5):
            v = list(w)
            for _ in range(k * len(w) // 90):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            rows.append((100 + 10 * i + k, " ".join(v)))
    docs = spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA).repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in S.setsketch_groups(docs, shingle=5, percent=80).collect())
    want = brute_of(rows, 5, 80)
    assert got == want and got[1][2] == 0 and got[2][2] == 2
    assert len({c for *_, c in want}) > 70 and sum(d != c for d, _, c in want) > 60


def test_whole_small_table_with_five_words(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in S.setsketch_groups(docs, shingle=5, percent=80).collect())
    assert got == brute_of(rows, 5, 80)


def test_bands_follow_from_the_threshold():
    assert (S.Rule().bands, S.Rule(5, 80).bands, S.Rule(5, 90).bands) == (16, 22, 16)
    for percent in (70, 75, 80, 85, 95):
        assert (1 - (percent / 100) ** S.ROWS) ** S.Rule(5, percent).bands <= 1e-5
