"""K-d tree shards: balance, whole groups, slots, and a brute-force tree."""

import random
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from custval.llm import kdtree as K
from custval.llm.common import table

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("shard", T.StringType()),
    ]
)


def check(df, rows, shards, slack):
    got = df.collect()
    size = {}
    assert len(got) == len(rows)
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    for s in range(shards):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        size[s] = sum(r["size"] for r in mine)
    assert sum(size.values()) == sum(r["size"] for r in got)
    mean = sum(size.values()) / shards
    assert all(abs(v - mean) <= slack for v in size.values()), (mean, size)
    return got


def test_whole_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    largest = max(len(t.encode()) for _, t in rows)
    first = check(K.kd_shards(docs), rows, 16, 2 * largest)
    groups = {}
    text = dict(rows)
    for r in first:
        groups.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for t, s in groups.items() if len(t) < 1000)  # copies stay together


def test_small_ranges_and_bins(spark, monkeypatch):
    monkeypatch.setattr(K, "RANGE_ROWS", 16)
    monkeypatch.setattr(K, "BINS", 16)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    largest = max(len(t.encode()) for _, t in rows)
    got = check(K.kd_shards(docs.repartition(5), shards=4), rows, 4, 2 * largest)
    assert len({r.shard for r in got}) == 4


def brute(points, shards):
    """points: (weight, dims); the shards of a tree that cuts at the nearest point boundary."""
    whole = [max(p[1][d] for p in points) - min(p[1][d] for p in points) for d in range(2)]
    out = {}

    def split(part, first, k):
        if k == 1:
            out.update({p[2]: first for p in part})
            return
        wide = [(max(p[1][d] for p in part) - min(p[1][d] for p in part)) / whole[d] for d in range(2)]
        d = wide.index(max(wide))
        part = sorted(part, key=lambda p: p[1][d])
        half, total, cut = sum(p[0] for p in part) * (k // 2) / k, 0, 0
        for i, p in enumerate(part):
            if total + p[0] >= half:
                cut = i if half - total < total + p[0] - half else i + 1
                break
            total += p[0]
        split(part[:cut], first, k // 2)
        split(part[cut:], first + k // 2, k - k // 2)

    split(points, 0, shards)
    return out


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(K, "SPLIT", 1e-9)
    rows = [(i, "x" * rnd.randrange(1, 90) + str(i), None, None, str(rnd.randrange(10**6))) for i in range(150)]
    dims = {i: (rnd.randrange(10**9), rnd.randrange(-500, 500) * 1000 + i) for i in range(150)}
    data = spark.createDataFrame([(i, *dims[i]) for i in range(150)], "doc_id long, x long, y long")
    docs = spark.createDataFrame(rows, SCHEMA).join(data, "doc_id")
    got = K.kd_shards(docs, shards=7, dimensions=[F.col("x"), F.col("y")]).collect()
    want = brute([(len(t) + 1, dims[i], i) for i, t, *_ in rows], 7)
    assert {r.doc_id: r.shard for r in got} == want


def test_edges(spark):
    rnd = random.Random(5)
    rows = [(i, "same text " * 30, "en", f"s{i % 3}", "") for i in range(900)]  # most bytes in one group
    rows += [(1000 + i, "t" * rnd.randrange(200), rnd.choice(["de", None]), rnd.choice(["a", "b", None]), "") for i in range(300)]
    rows += [(5000, None, None, None, None), (None, "", None, None, None), (5000, None, None, None, None), (7, "w", "en", "q", "1")]
    check(K.kd_shards(spark.createDataFrame(rows, SCHEMA).repartition(3)), rows, 16, 3500)
    check(K.kd_shards(spark.createDataFrame(rows[-4:], SCHEMA), shards=4), rows[-4:], 4, 10)
    one = K.kd_shards(spark.createDataFrame(rows, SCHEMA), shards=None, target_bytes=10**9).collect()
    assert {r.shard for r in one} == {0}


def test_empty_table(spark):
    assert K.kd_shards(spark.createDataFrame([], SCHEMA)).collect() == []


def test_values_with_a_common_start(spark):
    """source_01 to source_20 are twenty values: the tree splits by source where nothing else differs."""
    rows = [(i, f"text {i:05}", "en", f"source_{i % 20 + 1:02}", "") for i in range(2000)]
    got = check(K.kd_shards(spark.createDataFrame(rows, SCHEMA), shards=4), rows, 4, 60)
    shards = {}
    for r in got:
        shards.setdefault(r.doc_id % 20, set()).add(r.shard)
    assert sum(len(s) == 1 for s in shards.values()) >= 17
    ranks = {r.value: r["rank"] for r in K.value_ranks(spark.createDataFrame(rows, SCHEMA), "source").collect()}
    assert [ranks[v] for v in sorted(ranks, key=str.encode)] == list(range(1, 21))


def test_copies_share_a_shard_unless_it_is_too_small(spark):
    """Groups of a tenth to nine tenths of a shard stay whole, and the shards stay even; one of two shards' size is split."""
    rnd = random.Random(6)
    rows, i = [], 0
    for size in (9000, 7000, 6000, 5000, 3000, 2000, 1500, 1000, 20_000):
        text = "".join(rnd.choice("abcdef ") for _ in range(99))
        for _ in range(size // 100):
            rows.append((i, text, "en", "s", ""))
            i += 1
    while i * 100 < 80_000:
        rows.append((i, "".join(rnd.choice("abcdef ") for _ in range(99)), rnd.choice(["en", "de"]), f"s{i % 7}", ""))
        i += 1
    got = check(K.kd_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), shards=8), rows, 8, 250)
    text, groups = {r[0]: r[1] for r in rows}, {}
    for r in got:
        groups.setdefault(text[r.doc_id], set()).add(r.shard)
    apart = [t for t, s in groups.items() if len(s) > 1]
    assert len(apart) == 1 and sum(t == apart[0] for t in text.values()) == 200


def test_whole_table_keeps_its_groups(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    apart = K.kd_shards(docs).groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("n")).where("n > 1").count()
    assert apart == 0
