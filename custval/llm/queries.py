"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custval.llm.bpe import bpe_round_trip
from custval.llm.chat import chat_digests
from custval.llm.common import table
from custval.llm.curve import pack
from custval.llm.kdtree import kd_shards
from custval.llm.language import label_languages
from custval.llm.mixing import mix
from custval.llm.multiindex import similar_vectors
from custval.llm.phrases import collocations
from custval.llm.repetition import repetition_rules
from custval.llm.secrets import secret_report
from custval.llm.setsketch import setsketch_groups
from custval.llm.spelling import spelling_variants, word_counts
from custval.llm.wavelet import token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


@query
def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_groups(table(spark, sf_dir, "documents"))


@query
def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_languages(table(spark, sf_dir, "documents"))


@query
def op10_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


#: A conversation of control strings only, added to the table by op2.
HARD_TURN = r"\### Assistant: </turn> ok"


@query
def op2_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TURN), (-7, 1, "assistant", HARD_TURN)], "conv_id long, turn long, role string, text string")
    return chat_digests(turns.union(hard))


ORACLE["op2_grammar_round_trip"] = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{HARD_TURN}'
    UNION ALL SELECT -7, 1, 'assistant', '{HARD_TURN}'
), sized AS (
    SELECT *, regexp_matches(role, '[\\]|</turn>|###|: ') OR regexp_matches(text, '[\\]|</turn>|###') AS clash,
        list_sum(list_transform([role, text], lambda s:
            length(s) - length(replace(s, '\', '')) + (length(s) - length(replace(s, '</turn>', ''))) // 7
            + (length(s) - length(replace(s, ': ', ''))) // 2
            + coalesce(list_sum(list_transform(regexp_extract_all(s, '#{{3,}}'), lambda r: length(r) - 1)), 0))) AS extra
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(14 + length(role) + length(text) + CASE WHEN clash THEN extra ELSE 0 END) AS BIGINT) AS formatted_chars,
    count(*) FILTER (clash) AS n_escaped
FROM sized GROUP BY conv_id
"""


@query
def op9_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1))


@query
def op6_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


@query
def op11_era_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=10, top=2000)


ORACLE["op11_era_phrases"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \t]+') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\n\x0b\f\r]')) AS piece FROM documents)
), grams AS (
    SELECT lang, size, phrase, count(*) AS f FROM (
        SELECT lang, 1 AS size, unnest(w) AS phrase FROM pieces
        UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) FROM pieces WHERE len(w) > 1
        UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) FROM pieces WHERE len(w) > 2
    ) GROUP BY ALL
), total AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 10
), halves AS (
    SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), cuts AS (
    SELECT h.*, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * h.a * h.a) // (CAST(l.f AS HUGEINT) * r.f) AS score
    FROM halves AS h JOIN grams AS l ON l.lang = h.lang AND l.phrase = h.one JOIN grams AS r ON r.lang = h.lang AND r.phrase = h.two
), best AS (
    SELECT lang, phrase, a, arg_min(struct_pack(l, r, score), (score, k)) AS cut FROM cuts GROUP BY ALL
), parts AS (
    SELECT lang, phrase, max(a) AS most FROM (
        SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE size = 3) GROUP BY ALL
), kept AS (
    SELECT best.* FROM best LEFT JOIN parts USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, cut.l AS l, cut.r AS r, n, CAST(cut.score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query
def op12_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


@query
def op13_bloom_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), least=7, occurrences=2, typo=31), ratio=10)


#: Words by their deletions: two words are one edit apart if one is the other less a letter, or both less the same place agree.
ORACLE["op13_bloom_spelling"] = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS r(i))
), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
    SELECT run, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b
    FROM runs
), hashed AS (
    SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS h
    FROM bytes, crc_table
), vocabulary AS (
    SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(times) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND n >= 2
), less AS (
    SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM vocabulary, unnest(range(1, length(word) + 1)) AS u(i)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less AS a JOIN vocabulary AS b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less AS a JOIN vocabulary AS b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word
), formed AS (
    SELECT v.word, CASE WHEN most >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN most END AS form_n
    FROM vocabulary AS v LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM formed AS f JOIN walk USING (word) JOIN formed AS last ON walk.root = last.word AND last.form IS NULL
"""
