"""From raw documents to token ids: the stages in order, each over all its predecessor kept.

``run(spark, sf_dir)`` applies STAGES to the ``documents`` table.  Every stage's
result is written as Parquet to the shared checkpoint folder and read back as the
next one's input, so a lost executor repeats only work of the running stage.

1. language ID drops documents without a language (no letter, or all languages need equally many
   phrases) and fills in missing labels;
2. MinHash near-dedup (SetSketch) keeps one document of each group, the one of smallest id;
3. secret scans put a mark in the place of every secret;
4. mixing draws the documents to the weights, and repeats those drawn more than once;
5. byte-level BPE encodes them: the result has one row of token ids per document drawn.

Repeated rows (same id and text) count as copies in stage 2, and as documents of their own elsewhere.
An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custval.llm.bpe import bpe_round_trip
from custval.llm.common import document_batches, table
from custval.llm.language import UNKNOWN, fit_languages, held_out, identify
from custval.llm.mixing import mix
from custval.llm.secrets import redact
from custval.llm.setsketch import setsketch_groups
from custval.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language; label those that have no label."""
    document_batches(spark)
    model = fit_languages(docs.where(~held_out()))
    kept = {"given": "lang", "body": "text", "origin": "source", "chars": "n_chars"}
    found = identify(docs, model, keep=kept)
    ahead = F.lit(True) if len(model) < 2 else F.col("score") > 1.0 / len(model) + 1e-9  # not all languages alike
    known = found.where((F.col("lang_pred") != UNKNOWN) & ahead)
    return known.select(
        "doc_id",
        F.col("body").alias("text"),
        F.coalesce("given", "lang_pred").alias("lang"),
        F.col("origin").alias("source"),
        F.col("chars").alias("n_chars"),
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, once."""
    document_batches(spark)
    docs = docs.select(*COLUMNS).withColumn("tag", F.xxhash64("text"))
    kept = setsketch_groups(docs, tag=F.col("tag")).where("kept").select(F.col("doc_id").alias("id"), F.col("tag").alias("mark"))
    same = docs["doc_id"].eqNullSafe(kept["id"]) & (docs["tag"] == kept["mark"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "tag"]).select(*COLUMNS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    document_batches(spark)
    clean = redact(docs, keep={"language": "lang", "origin": "source"})
    return clean.select(
        "doc_id", "text", F.col("language").alias("lang"), F.col("origin").alias("source"), F.length("text").cast("long").alias("n_chars")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them (a part of a document counts as the nearest whole number)."""
    document_batches(spark)
    docs = docs.select(*COLUMNS).withColumn("tag", F.xxhash64("text", "source"))
    taken = mix(docs, WEIGHTS, carry=[F.col("tag")]).where("taken > 0")
    times = (
        taken.groupBy(F.col("doc_id").alias("id"), F.col("carry_0").alias("mark"))  # repeated rows together
        .agg(F.avg(F.col("taken") / F.col("size")).alias("passes"))
        .select("id", "mark", F.floor(F.col("passes") + 0.5).cast("int").alias("times"))
        .where("times > 0")
    )
    same = docs["doc_id"].eqNullSafe(times["id"]) & (docs["tag"] == times["mark"])
    drawn = docs.join(times, same).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return drawn.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document drawn, with the digests of ids and decoded bytes."""
    document_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(docs, ranks, public_tokenizers.PATTERN, ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", remove_secrets),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: Grouping by similarity, cross-parsing and merge replay are beyond SQL: tests/llm compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
