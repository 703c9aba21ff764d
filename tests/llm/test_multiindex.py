"""Inverted multi-index: links, degrees and components against brute force, and the traversal."""

import numpy as np
from pyspark.sql import types as T

from custval.llm import multiindex as X
from custval.llm.common import table

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("node", T.StringType()),
    ]
)


def brute(rows, threshold=0.98):
    good = []
    for _, v, label, *_ in rows:
        ok = label is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
        good.append(np.array(v, np.float32).astype(np.float64) if ok else None)
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = good[i], good[j]
            if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2]:
                continue
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(root(i))) for i, r in enumerate(rows)), key=str)


def compare(df, rows):
    got = df.collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_whole_small_table(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    compare(X.similar_vectors(vectors), rows)  # recall 1


def test_edges_and_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(i, [float(c) for c in base + rng.normal(size=16) * s], i % 2, "") for i, s in enumerate(np.linspace(0, 0.6, 160))]
    rows += [(500 + i, [float(c) for c in base], 0, None) for i in range(40)]
    rows += [(600 + i, [float(c) for c in rng.normal(size=16)], int(i % 3), "x") for i in range(150)]
    rows += [(900, None, 0, ""), (901, [], 0, ""), (902, [0.0] * 16, 0, ""), (903, [float("nan")] * 16, 0, ""), (904, [float("inf")] * 16, 0, "")]
    rows += [(905, [1.0, None], 0, ""), (906, [1.0, 0.1], 0, ""), (907, [1.0, 0.1], 0, ""), (907, [1.0, 0.1], 0, ""), (908, [1.0, 0.1], None, "")]
    rows += [(909, [2.0], 5, ""), (910, [3.0], 5, ""), (911, [-3.0], 5, ""), (None, [1.0, 0.1], 0, ""), (912, [3e38] * 4, 1, ""), (913, [1e-30] * 4, 1, "")]
    compare(X.similar_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)), rows)


def test_empty_table(spark):
    assert X.similar_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_link_lies_beyond_the_bound():
    rng = np.random.default_rng(2)
    points = X.unit(rng.normal(size=(600, 12)))
    near = X.unit(points + rng.normal(size=points.shape) * 0.03)
    books = X.fit_codebooks(list(points))[12]
    radius = 2 - 2 * X.THRESHOLD + 1e-9
    checked = 0
    for x, y in zip(points, near, strict=True):
        if x @ y < X.THRESHOLD:
            continue
        checked += 1
        halves = [(slice(0, 6), books[0]), (slice(6, 12), books[1])]
        cell = tuple(int(X.bounds(y[None, h], b)[0][0]) for h, b in halves)
        first, second = (X.bounds(x[None, h], b)[1][0] for h, b in halves)
        visited = X.traverse(first, second, radius)
        assert cell in visited
        bound = [first[i] + second[j] for i, j in visited]
        assert bound == sorted(bound)
        assert len(visited) == int((first[:, None] + second[None] <= radius).sum())
    assert checked > 300


def test_searches_in_step_visit_what_one_search_does():
    """Nearest first, and for each codeword of the first half the cells of the single traversal."""
    rng = np.random.default_rng(3)
    points = X.unit(rng.normal(size=(200, 12)))
    first_book, second_book = X.fit_codebooks(list(points))[12]
    radius = 2 - 2 * X.THRESHOLD + 1e-9
    first, second = X.bounds(points[:, :6], first_book)[1], X.bounds(points[:, 6:], second_book)[1]
    visited = [[] for _ in points]
    for code in range(len(first_book)):
        bound = np.zeros(len(points))
        for searches, cell in X.nearest_first(first[:, code], second, radius):
            now = first[searches, code] + second[searches, cell]
            assert (now <= radius).all() and (now >= bound[searches]).all()
            bound[searches] = now
            for i in searches.tolist():
                visited[i].append((code, cell))
    for i in range(len(points)):
        want = X.traverse(first[i], second[i], radius)
        assert len(visited[i]) == len(want) and set(visited[i]) == set(want)
