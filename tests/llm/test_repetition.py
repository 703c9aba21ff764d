"""Suffix-array repetition against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from custval.llm import repetition as R

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())]
)


def brute(text):
    text = text or ""
    w = text.encode().split()
    n = len(w)

    def union(least):
        mask = [False] * n
        for k in range(least, n):
            seen = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
            for i in range(n - k + 1):
                if seen[tuple(w[i : i + k])] > 1:
                    mask[i : i + k] = [True] * k
            if max(seen.values()) == 1:
                break
        return mask

    longest = max((k for k in range(1, n) if max(Counter(tuple(w[i : i + k]) for i in range(n - k + 1)).values()) > 1), default=0)
    repeats = 0
    for k in range(R.MIN_REPEAT, longest + 1):
        at = {}
        for i in range(n - k + 1):
            at.setdefault(tuple(w[i : i + k]), []).append(i)
        for p in at.values():
            before = {w[i - 1] if i else None for i in p}
            after = {w[i + k] if i + k < n else None for i in p}
            left = len(before) > 1 or None in before
            right = len(after) > 1 or None in after
            repeats += len(p) > 1 and left and right
    lines = [x for x in text.split("\n") if x.encode().split()]
    chars = [len(x.decode()) for x in w]
    covered = sum(c for c, m in zip(chars, union(R.MIN_REPEAT), strict=True) if m)
    return {
        "n_words": n,
        "word_chars": sum(chars),
        "n_symbols": sum(c in R.SYMBOLS for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": sum(union(R.WINDOW)),
        "covered_chars": covered,
        "longest_repeat": longest if longest >= R.MIN_REPEAT else 0,
        "n_repeats": repeats,
    }


def texts():
    rnd = random.Random(5)
    out = ["", None, " \t\n", "a", "one\x1ctwo three", "x " * 40, "a b " * 30, "é ü z | # $" * 9, "l one\nl one\n\n \nl two\nl one"]
    for size in (10, 25, 60, 150):
        for words in (2, 3, 8, 40):
            out.append(" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäöüABCDEFGHIJK"[:words]) for _ in range(size)))
    base = [f"w{i}" for i in range(40)]
    out.append(" ".join(base + ["q"] + base))
    out.append("\n".join([" ".join(base[:12])] * 5))
    return out


def test_against_brute_force(spark):
    data = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "x y", None), (3, "a", None)]
    got = R.repetition_rules(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, text in enumerate(texts()):
        want = brute(text)
        row = by_id[i].asDict()
        assert {k: row[k] for k in want} == want, (i, text)
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert row["base_failed"] == failed
        assert not (failed and row["kept"])


def test_suffix_array_is_sorted():
    rnd = random.Random(1)
    docs = [[rnd.randrange(3) for _ in range(rnd.randrange(60))] for _ in range(20)] + [[]] + [[1] * 50]
    codes = np.array([c for d in docs for c in d])
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    order, lcp, _ = R.longest_repeats(codes, offsets)
    want = sorted((k, d[i:], offsets[k] + i) for k, d in enumerate(docs) for i in range(len(d)))
    assert [w[2] for w in want] == order.tolist()
    for r in range(1, len(want)):
        a, b = want[r - 1], want[r]
        same = 0
        while a[0] == b[0] and same < min(len(a[1]), len(b[1])) and a[1][same] == b[1][same]:
            same += 1
        assert same == lcp[r]


def test_empty_table(spark):
    assert R.repetition_rules(spark.createDataFrame([], SCHEMA)).collect() == []
