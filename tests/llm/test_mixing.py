"""Mixing: targets, flows against brute force, what is taken, reruns."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custval.llm import mixing as M
from custval.llm.common import table

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
    ]
)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(df, rows, weights=(5, 2, 1)):
    got = df.collect()
    assert len(got) == len(rows)
    by = {}
    for _, text, source, *_ in rows:
        by[source] = by.get(source, 0) + words(text)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    target = M.water_fill([by[s] for s in names], [float(weights[i % len(weights)]) for i in range(len(names))], sum(by.values()), 3)
    assert sum(target) == pytest.approx(sum(by.values()))
    want = sorted((d, words(t), by[s], round(target[names.index(s)], 6)) for d, t, s, *_ in rows)
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got) == want
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    source = {d: s for d, _, s, *_ in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        taken[source[r.doc_id]] += r.taken
    for s, t in zip(names, target, strict=True):
        assert abs(taken[s] - t) <= 1
    return sorted((r.doc_id, r.taken) for r in got)


def test_whole_small_table(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    first = check(M.mix(docs, (5, 2, 1)), rows)
    monkeypatch.setattr(M, "RANGE_ROWS", 8)  # ranges do not change the draw
    assert check(M.mix(docs.repartition(7), (5, 2, 1)), rows) == first


def test_edges(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)) + f" d{i % 40}", rnd.choice(["a", "b", "ß", None, "z"]), "x") for i in range(300)]
    rows += [(1000, None, "a", ""), (1001, "", "empty", ""), (1002, " \n", "empty", ""), (1003, "one\x1cword", "tiny", None)]
    rows += [(2000 + i, "same text here", s, "") for i, s in enumerate(["a", "b", None] * 20)]
    rows += [(3000, "long " * 50_000, "z", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    first = check(M.mix(docs, (5, 2, 1)), rows)
    assert check(M.mix(docs.repartition(5), (5, 2, 1)), rows) == first
    nothing = spark.createDataFrame([(None, None, None, None), (None, None, None, None)], SCHEMA)
    assert [(r["size"], r.target, r.taken) for r in M.mix(nothing, (5, 2, 1)).collect()] == [(0, 0.0, 0)] * 2


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA), (5, 2, 1)).collect() == []


def test_shared_texts_are_repeated_last(spark):
    """Source a needs the shared text again and again, so b does with its own."""
    rows = [(1, "s " * 100, "a", ""), (2, "s " * 100, "b", ""), (3, "b " * 300, "b", "")]
    got = {r.doc_id: r.taken for r in M.mix(spark.createDataFrame(rows, SCHEMA), (1, 1)).collect()}
    assert got == {1: 250, 2: 0, 3: 250}


def test_flow_is_least_cost():
    rnd = random.Random(11)

    def cost(total, once):
        out, k, paid = 0, 0, 0
        while total > 0:
            step = once if k == 0 else once * 2 ** (k - 1)
            out += k * min(total, step)
            total -= step
            k += 1
        return out + paid

    for _ in range(60):
        p, s = rnd.randrange(1, 4), rnd.randrange(1, 3)
        once = np.array([rnd.randrange(1, 3) for _ in range(p)])
        capacity = np.array([[rnd.choice([0, 1, 2, 3]) for _ in range(s)] for _ in range(p)])
        demand = np.array([rnd.randrange(0, 4) for _ in range(s)])
        best = None
        for f in itertools.product(*[range(c + 1) for c in capacity.ravel()]):
            f = np.array(f).reshape(p, s)
            if (f.sum(axis=0) <= demand).all():
                key = (-f.sum(), sum(cost(t, o) for t, o in zip(f.sum(axis=1), once, strict=True)))
                best = key if best is None else min(best, key)
        got = M.least_cost_flow(once, capacity, demand)
        assert (got >= 0).all() and (got <= capacity).all() and (got.sum(axis=0) <= demand).all()
        assert (-got.sum(), sum(cost(t, o) for t, o in zip(got.sum(axis=1), once, strict=True))) == best


def test_targets():
    assert M.water_fill([10, 100, 100], [5.0, 2.0, 1.0], 210, 3) == pytest.approx([30, 120, 60])
    assert M.water_fill([], [], 0, 3) == [] and M.water_fill([0, 0], [5.0, 2.0], 0, 3) == [0.0, 0.0]


def test_sizes_in_a_row(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "9")], SCHEMA)
    r = M.mix(docs, (1,), carry=(F.col("target"), F.length("text"))).first()
    assert (r["size"], r.taken, r.carry_0, r.carry_1) == (2, 2, "9", 3)


def test_every_pattern_counts(spark):
    """21,679 patterns of 2 to 5 of 20 sources, asked for no more than their distinct words: nothing is taken twice."""
    groups = [g for k in range(2, 6) for g in itertools.combinations(range(20), k)]
    rows = [(g, s) for g, group in enumerate(groups) for s in group]
    docs = pa.table(
        {
            "doc_id": list(range(len(rows))),
            "text": [f"text{g} of" if g < 20_000 else f"text{g}" for g, _ in rows],
            "source": [f"s{s:02d}" for _, s in rows],
        }
    )
    size = [2 if g < 20_000 else 1 for g in range(len(groups))]
    whole = sum(size[g] for g, _ in rows)
    once = sum(size)
    taken = [0] * len(groups)
    for r in M.mix(spark.createDataFrame(docs), (1,), share=0.95 * once / whole).select("doc_id", "taken").toLocalIterator():
        taken[rows[r.doc_id][0]] += r.taken
    assert abs(sum(taken) - 0.95 * once) <= 1
    assert all(n <= most for n, most in zip(taken, size, strict=True))
