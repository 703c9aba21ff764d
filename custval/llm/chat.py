r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn as ``### Role: text</turn>`` and a line
break.  A deterministic parser reads it back: each turn starts where the last
ended, the role ends at the first ``: ``, the text at the first ``</turn>`` and line
break, and a backslash stands for the character after it.  Turns whose plain
rendering does not parse back to their source, or which hold a control string, are
escaped (a backslash goes into every control string and before every backslash) and
must then parse back; an error is raised if one did not.  Other texts stay as they are.

The loss mask is the list of spans of assistant texts in the formatted string,
found by the parser.

One shuffle gathers the turns of each conversation, whose formatted text is one value.

Defined results: null texts and roles are empty; turns are ordered by turn, then
role, then text (nulls first), repeated rows included; a null conversation id is a
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custval.llm.common import keyed

BEGIN, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
#: Turns whose places are summed up together.
STEP = 256
#: One turn of a formatted conversation, starting where the last one ended.
TURN = r"(?s)\G### (.*?): (.*?)</turn>\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit(AFTER_ROLE), text, F.lit(END))


def escape(value: Column) -> Column:
    r"""A backslash before every backslash and inside every control string, so that none is left."""
    value = F.regexp_replace(value, r"\\", r"\\\\")
    value = F.replace(value, F.lit("</turn>"), F.lit(r"<\/turn>"))
    value = F.replace(value, F.lit(AFTER_ROLE), F.lit(r":\ "))
    return F.regexp_replace(value, r"(?<=#)#(?=#)|(?<=##)#", r"\\#")


def unescape(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def parse(formatted: Column) -> Column:
    """Turns (role, text as it stands, start of the text) of a formatted conversation."""
    turns = F.arrays_zip(
        F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)).alias("role"),
        F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)).alias("text"),
    )
    fixed = len(BEGIN) + len(AFTER_ROLE)

    def taken(t: Column) -> Column:
        return F.length(t["role"]) + F.length(t["text"]) + fixed + len(END)

    def running(values: Column) -> Column:
        """Sums of the elements before each; arrays grow by copying, so STEP at a time."""
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(
            values, nothing, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums"))
        )

    def part(turns: Column, k: Column) -> Column:
        some = F.slice(turns, k * STEP + 1, STEP)
        return F.struct(some.alias("turns"), running(F.transform(some, taken)).alias("before"))

    def placed(parts: Column) -> Column:
        bases = running(F.transform(parts, lambda p: p["before"]["at"]))["sums"]

        def starts(p: Column, base: Column) -> Column:
            return F.zip_with(
                p["turns"],
                p["before"]["sums"],
                lambda t, at: F.struct(t["role"].alias("role"), t["text"].alias("text"), (base + at + fixed + F.length(t["role"])).alias("start")),
            )

        return F.flatten(F.zip_with(parts, bases, starts))

    def numbers(turns: Column) -> Column:
        return F.sequence(F.lit(0), F.floor(F.size(turns) / STEP).cast("int"))

    parts = F.transform(F.array(turns), lambda ts: F.transform(numbers(ts), lambda k: part(ts, k)))
    return F.transform(parts, placed)[0]


def _same(rendered: Column, role: Column, text: Column) -> Column:
    """Whether one rendered turn parses back to its source and nothing is left over."""
    whole = F.regexp_extract(rendered, TURN, 0) == rendered
    return whole & (unescape(F.regexp_extract(rendered, TURN, 1)) == role) & (unescape(F.regexp_extract(rendered, TURN, 2)) == text)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_escaped (turns that needed escaping)."""
    rows = keyed(
        turns, conv_id=conv_col, turn=turn_col, role=F.coalesce(F.col(role_col), F.lit("")), text=F.coalesce(F.col(text_col), F.lit(""))
    )
    plain = render(F.col("role"), F.col("text"))
    safe = render(escape(F.col("role")), escape(F.col("text")))
    marked = [F.col(c).contains(m) for c in ("role", "text") for m in ("\\", "</turn>", "###")]
    clash = ~_same(plain, F.col("role"), F.col("text")) | F.col("role").contains(AFTER_ROLE)
    rows = rows.withColumn("clash", reduce(or_, marked, clash))
    rows = rows.withColumn("rendered", F.when(F.col("clash"), safe).otherwise(plain))
    checked = F.when(
        F.col("clash") & ~_same(F.col("rendered"), F.col("role"), F.col("text")), F.raise_error(F.lit("a turn does not survive the round trip"))
    ).otherwise(F.col("rendered"))
    one = F.struct("turn", "role", "text", "clash", checked.alias("rendered"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["clash"])).cast("long").alias("n_escaped"),
    )


def read_chats(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """What the parser recovers: the columns of ``formatted``, turns (role, text), and the loss mask.

    ``loss`` holds the spans (start, end) of the texts of ``loss_role`` in the formatted
    string, in code points; ``loss_text`` their unescaped content, as the parser read it there.
    """
    found = formatted.withColumn("parsed", parse(F.col("formatted")))
    of_loss = F.filter("parsed", lambda t: t["role"] == loss_role)
    return found.select(
        "*",
        F.transform("parsed", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        F.transform(of_loss, lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["text"])).alias("end"))).alias("loss"),
        F.array_join(F.transform(of_loss, lambda t: unescape(t["text"])), "").alias("loss_text"),
    )


def chat_digests(turns: DataFrame) -> DataFrame:
    """Format, read back, and digest: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_escaped."""
    back = read_chats(format_chats(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
    )
