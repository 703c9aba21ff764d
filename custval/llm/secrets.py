"""Secret scans: patterns, and sliding-window Shannon entropy, in DataFrame functions only.

Base kinds are patterns.  The method adds candidate strings of each character
class (maximal runs of the class): a window slides over the candidate, the counts
of its characters are updated by the one that enters and the one that leaves, and
with them the sum of c * log2(c), from which the entropy follows.  Adjoining windows
at or above the class's threshold make a span.  Candidates on the allow list are
left out.

Everything is computed within the row (no shuffle, no Python): positions come from
the lengths of the matches and of the gaps between them.  One row at a time bounds
the memory.

Defined results: a null text is empty and has no spans; repeated rows are all
returned; an empty table gives an empty result; other columns are ignored.  Spans
are in code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custval.llm.common import keyed

#: Base kinds in the order they are listed: pattern, group whose length counts, least length.  Fixed values.
BASE = (
    (
        "assign",
        r"""(?=[pPsStTaA])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
)

#: Window in characters, and for each class: name, its characters, least entropy in bits.
WINDOW = 20
CLASSES = (
    ("entropyhex", "0123456789abcdefABCDEF", 3.0),
    ("entropybase64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.9),
)
#: A word in a candidate: camel case or a single case.  A piece that says it is a sample has less than a window besides.
_WORD = r"(?:[A-Za-z][a-z]{2,}(?:[A-Z][a-z]{2,})++|[A-Z]?[a-z]++|[A-Z]++)"
_SAMPLE = r"(?i:example|sample|dummy|placeholder|changeme|xxxx)"
_PIECE = rf"(?:(?=[A-Za-z0-9]{{0,19}}{_SAMPLE})[A-Za-z0-9]{{1,23}}+(?![A-Za-z0-9])|{_WORD}?[0-9]{{0,4}}+)"
#: Candidates that match one of these are no secrets: single-case words, words joined by marks, camel case,
#: numbers, UUIDs, and samples.  Each piece between marks must be a word (or a sample) by itself.  Repeated groups are
#: possessive: the regular expressions of the JVM recurse for every repeat of a group that may be given back.
ALLOW = (
    r"[A-Z]?[a-z]+|[A-Z]+",
    rf"{_WORD}(?:[_/+-]++{_WORD}?[0-9]{{0,4}}+)++",
    r"[A-Za-z][a-z]{2,}+(?:[A-Z][a-z]{2,}+)++",
    r"[0-9]++(?:[-/+_][0-9]++)*+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    rf"(?=.*{_SAMPLE}){_PIECE}(?:[_/+-]++{_PIECE})*+",
)

KINDS = tuple(k[0] for k in BASE) + tuple(c[0] for c in CLASSES)
_SPAN = "array<struct<start:int,kind:int,end:int,piece:string>>"


#: Pieces of a text that are put together at a time, and characters of the blocks in which a text is rewritten.
STEP = 256
BLOCK = 4096


def _moved(span: Column, by: Column) -> Column:
    return F.struct((span["start"] + by).alias("start"), span["kind"].alias("kind"), (span["end"] + by).alias("end"), span["piece"].alias("piece"))


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's matches whose ``group`` has ``least`` characters, in order."""
    p = F.lit(pattern)
    piece = F.arrays_zip(
        F.regexp_extract_all(text, p, F.lit(0)).alias("whole"),
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("part"),
    )
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("found"))

    def merge(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["whole"].alias("piece")))
        found = F.when(F.length(x["part"]) >= least, F.concat(F.coalesce(acc["found"], none), span))
        return F.struct(F.coalesce(end, begin).alias("at"), F.coalesce(found, acc["found"]).alias("found"))

    def part(pieces: Column, k: Column) -> Column:
        return F.aggregate(F.slice(pieces, k * STEP + 1, STEP), start, merge)

    def placed(parts: Column) -> Column:
        """The spans of all parts, each moved by the lengths of those before it."""
        before = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("base")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["base"], F.array(acc["at"])).alias("base")),
            lambda acc: acc["base"],
        )
        return F.flatten(F.zip_with(parts, before, lambda x, base: F.transform(F.coalesce(x["found"], none), lambda s: _moved(s, base))))

    # arrays grow by copying, so the pieces are taken STEP at a time
    parts = F.transform(F.array(piece), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / STEP).cast("int")), lambda k: part(p, k)))
    spans = F.transform(parts, placed)[0]
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def entropy_spans(candidate: Column, kind: int, alphabet: str, least: float) -> Column:
    """Spans of adjoining windows of ``candidate`` (start, end, piece) with at least ``least`` bits of entropy."""
    chars = F.split(candidate["piece"], "")
    steps = F.arrays_zip(chars.alias("enters"), F.concat(F.array_repeat(F.lit(None).cast("string"), WINDOW), chars).alias("leaves"))
    # entropy = log2(WINDOW) - sum(c * log2(c)) / WINDOW; weights of a count in the sum
    most = WINDOW * (math.log2(WINDOW) - least) + 1e-9
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("n"),
        F.lit(None).cast("int").alias("begin"),
        F.lit(0).alias("end"),
        F.array().cast(_SPAN).alias("found"),
        F.array().cast(f"array<{_SPAN}>").alias("full"),  # parts of STEP spans: arrays grow by copying
    )

    def span(acc: Column) -> Column:
        one = F.struct(
            (candidate["start"] + acc["begin"]).alias("start"),
            F.lit(kind).alias("kind"),
            (candidate["start"] + acc["end"]).alias("end"),
            F.lit("").alias("piece"),
        )
        return F.array(one)

    def merge(acc: Column, x: Column) -> Column:
        enters, leaves = _place(x["enters"], alphabet), _place(x["leaves"], alphabet)
        moved = F.transform(
            acc["counts"], lambda c, i: c + F.when(i == enters, 1).otherwise(0) - F.when(i == leaves, 1).otherwise(0)
        )
        old_in, old_out = F.get(acc["counts"], enters), F.get(acc["counts"], leaves)
        gain = F.get(weight, old_in + 1) - F.get(weight, old_in)
        loss = F.when(leaves.isNull(), 0.0).otherwise(F.get(weight, old_out) - F.get(weight, old_out - 1))
        change = F.when(F.coalesce(leaves, F.lit(-1)) == enters, 0.0).otherwise(gain - loss)
        total, n = acc["sum"] + change, acc["n"] + 1
        high = (n >= WINDOW) & (total <= most)
        apart = acc["begin"].isNotNull() & (n - WINDOW > acc["end"])
        filled = F.size(acc["found"]) >= STEP
        return F.when(x["enters"].isNull(), acc).otherwise(
            F.struct(
                moved.alias("counts"),
                total.alias("sum"),
                n.alias("n"),
                F.when(high & (acc["begin"].isNull() | apart), n - WINDOW).otherwise(acc["begin"]).alias("begin"),
                F.when(high, n).otherwise(acc["end"]).alias("end"),
                F.when(high & apart, F.when(filled, span(acc)).otherwise(F.concat(acc["found"], span(acc)))).otherwise(acc["found"]).alias("found"),
                F.when(high & apart & filled, F.concat(acc["full"], F.array(acc["found"]))).otherwise(acc["full"]).alias("full"),
            )
        )

    def finish(acc: Column) -> Column:
        last = F.when(acc["begin"].isNotNull(), F.concat(acc["found"], span(acc))).otherwise(F.array().cast(_SPAN))
        return F.flatten(F.concat(acc["full"], F.array(last)))

    return F.aggregate(steps, start, merge, finish)


def _place(char: Column, alphabet: str) -> Column:
    """0-based place of a character in the alphabet; null for null."""
    return F.instr(F.lit(alphabet), char) - 1


def candidates(text: Column, kind: int, alphabet: str) -> Column:
    """Maximal runs of the alphabet's characters, at least a window long, that the allow list does not cover."""
    chars = "[" + alphabet.replace("-", r"\-") + "]"
    found = matches(text, f"(?<!{chars}){chars}{{{WINDOW},}}+", kind)
    allowed = "^(" + "|".join(f"({a})" for a in ALLOW) + ")$"
    return F.filter(found, lambda c: ~c["piece"].rlike(allowed))


def high_entropy(text: Column, kind: int, alphabet: str, least: float) -> Column:
    """The entropy spans of all candidates of a class."""
    return F.flatten(F.transform(candidates(text, kind, alphabet), lambda c: entropy_spans(c, kind, alphabet, least)))


def _count(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, text, ``found``, the spans (start, kind, end) ordered by start and kind, and ``keep``.

    ``kind`` is the number of a name in ``KINDS``; ``keep`` names further columns to carry (new name: column).
    """
    keep = keep or {}
    rows = keyed(docs, doc_id=id_col, text=F.coalesce(F.col(text_col), F.lit("")), **keep)
    text = F.col("text")
    parts = [matches(text, pattern, i, group, least) for i, (_, pattern, group, least) in enumerate(BASE)]
    parts += [high_entropy(text, len(BASE) + j, alphabet, least) for j, (_, alphabet, least) in enumerate(CLASSES)]
    spans = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", "text", F.array_sort(spans).alias("found"), *keep)


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"] < len(BASE))
    counts = [_count(found, i).alias(f"n_{name}") for i, (name, *_) in enumerate(BASE)]
    return scan(docs).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(found).alias("spans"))


def redact(
    docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None
) -> DataFrame:
    """doc_id, text with every union of overlapping spans replaced by ``mark``, how many were, and ``keep``."""
    text, found = F.col("text"), F.col("found")

    def block(body: Column, k: Column) -> Column:
        """A block of the text without its secrets, and how many unions of spans begin in it."""
        low = k * BLOCK
        start = F.struct(F.lit("").alias("out"), low.alias("at"), F.lit(0).alias("n"))

        def merge(acc: Column, s: Column) -> Column:
            before = F.substring(body, acc["at"] - low + 1, s["start"] - acc["at"])
            fresh = F.struct(F.concat(acc["out"], before, F.lit(mark)).alias("out"), s["end"].alias("at"), (acc["n"] + 1).alias("n"))
            inside = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"), acc["n"].alias("n"))
            return F.when(s["start"] < acc["at"], inside).otherwise(fresh)

        here = F.filter(found, lambda s: (s["end"] > low) & (s["start"] < low + BLOCK))
        rest = F.aggregate(here, start, merge, lambda acc: F.struct(acc["out"].alias("out"), F.substring(body, acc["at"] - low + 1, F.lit(BLOCK)).alias("rest"), acc["n"].alias("n")))
        return F.when(F.size(here) > 0, rest).otherwise(F.struct(F.lit("").alias("out"), body.alias("rest"), F.lit(0).alias("n")))

    blocks = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), block)
    done = scan(docs, id_col, text_col, keep).withColumn("_blocks", F.when(F.size(found) > 0, blocks))
    clean = F.array_join(F.transform("_blocks", lambda b: F.concat(b["out"], b["rest"])), "")
    count = F.aggregate(F.transform("_blocks", lambda b: b["n"]), F.lit(0), lambda acc, n: acc + n)
    return done.select(
        "doc_id", F.coalesce(clean, text).alias("text"), F.coalesce(count, F.lit(0)).cast("long").alias("n_secrets"), *(keep or {})
    )
