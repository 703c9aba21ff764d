"""Grammar round trip: recovered turns, the loss mask and its digests, hard texts, the SQL."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custval.llm import chat as C
from custval.llm import queries as Q

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("formatted", T.StringType()),
    ]
)


def rows():
    rnd = random.Random(6)
    parts = ["\\", "#", "##", "###", "### ", "#####", ": ", ":", " ", "</turn>", "</turn>\n", "<\\/turn>", "\n", "a", "é😀", "user: ", "$1", "### user: x</turn>\n"]
    out = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(["hi", None, "", "\\", "</turn>\n### user: x</turn>\n"])]
    out += [(2, 0, None, "no role", ""), (2, 1, "a: b", "t", ""), (2, 2, "user:", " : x", ""), (2, 3, "assistant", "y" * 200_000 + "\\" * 20_000, "")]
    out += [(None, None, "assistant", "null id", ""), (4, 1, "user", "same", ""), (4, 1, "user", "same", ""), (4, 0, "assistant", "### " * 3000, "")]
    for c in range(10, 60):
        for turn in range(rnd.randrange(1, 6)):
            text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 25)))
            out.append((c, turn, rnd.choice(["user", "assistant", "system", "a: \\b</turn>\n"]), text, None))
    return out


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    convs = {}
    for c, turn, role, text, _ in data:
        convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    got = {r.conv_id: r for r in C.read_chats(C.format_chats(df)).collect()}
    digests = {r.conv_id: r for r in C.chat_digests(df).collect()}
    assert got.keys() == digests.keys() == convs.keys()
    for c, turns in convs.items():
        turns = sorted(turns)
        r, d = got[c], digests[c]
        assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in turns]
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        assert r.loss_text == loss and len(r.loss) == sum(t[1] == "assistant" for t in turns)
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(turns), len(loss), len(r.formatted))
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].formatted.startswith("### user: hi</turn>\n### assistant: </turn>\n")


def test_escaped_texts_hold_no_control_string(spark):
    df = spark.createDataFrame(rows(), SCHEMA).select(C.escape(F.coalesce("text", F.lit(""))).alias("e"), F.coalesce("text", F.lit("")).alias("t"))
    for r in df.select("e", "t", C.unescape(F.col("e")).alias("back")).collect():
        assert r.back == r.t and not any(s in r.e for s in ("</turn>", ": ", "###"))


def test_hard_conversation_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = Q.QUERIES["op2_grammar_round_trip"](spark, sf)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(Q.ORACLE["op2_grammar_round_trip"]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)
    hard = got.where("conv_id = -7").first()
    assert hard.n_turns == 2 and hard.loss_chars == len(Q.HARD_TURN)
    assert hard.loss_sha256 == hashlib.sha256(Q.HARD_TURN.encode()).hexdigest()


def test_sql_on_hard_texts(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).drop("formatted")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.QUERIES["op2_grammar_round_trip"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(Q.ORACLE["op2_grammar_round_trip"]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert C.chat_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_spans_are_where_the_texts_stand(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for r in C.read_chats(C.format_chats(df)).collect():
        texts = [t.text for t in r.turns if t.role == "assistant"]
        for span, text in zip(r.loss, texts, strict=True):
            held = r.formatted[span.start : span.end]
            assert held == text if "\\" not in held else len(held) >= len(text)
            assert r.formatted[span.end :].startswith("</turn>\n") and r.formatted[: span.start].endswith(": ")


def test_very_many_turns(spark):
    """Tens of thousands of turns in one conversation, in seconds."""
    import time

    n = 40_000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id, IF(id % 7 = 0, ' ###', '')) AS text")
    C.chat_digests(df.where("turn < 10")).collect()
    began = time.time()
    row = C.chat_digests(df).first()
    took = time.time() - began
    texts = [f"text {i}" + " ###" * (i % 7 == 0) for i in range(n)]
    assert row.n_turns == n and row.loss_sha256 == hashlib.sha256("".join(texts[1::2]).encode()).hexdigest()
    assert took < 30, took
