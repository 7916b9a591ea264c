"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm import alignment, chat, collocations, decontamination, fingerprints, language, packing, simhash, substring, suffix_dedup, suffix_tree, token_counts, toxicity
from quillmeter.llm.common import crc_bucket


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents")).drop("n_same")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.windows(turns, public_tokenizers.path("byte_bpe_50k.json")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs, ~held_out)
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep_text=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train_chain(docs, _table(spark, sf_dir, "labels"), {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return toxicity.predict(docs, chain)


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(_table(spark, sf_dir, "documents"), crc_bucket("doc_id", 10) == 0)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_substring": op3_substring,
    "op4_chat": op4_chat,
    "op5_fingerprints": op5_fingerprints,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_suffix_dedup": op13_suffix_dedup,
}

#: An item's shingles, and those of every document, by position; runs of all words of items under five.
_OP8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS size, unnest([array_to_string(w[k:k + least(len(w), 5) - 1], ' ') FOR k IN range(1, len(w) - least(len(w), 5) + 2)]) AS g FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
s AS (SELECT DISTINCT size FROM i),
t AS (SELECT DISTINCT doc_id, size, unnest([array_to_string(w[k:k + size - 1], ' ') FOR k IN range(1, len(w) - size + 2)]) AS g FROM d, s WHERE len(w) >= size)
SELECT t.doc_id, i.item_id, any_value(n.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*) / any_value(n.n) AS containment
FROM t JOIN i ON t.g = i.g AND t.size = i.size JOIN n ON n.item_id = i.item_id
GROUP BY t.doc_id, i.item_id HAVING count(*) >= 0.8 * any_value(n.n)
"""

#: Phrases of pieces by position, all counted; cuts and longer phrases by joins.
_OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k AS size, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, range(1, 5) t(k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY lang, phrase, size),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 30 AND size > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, range(1, 4) t(k) WHERE k < size),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * k.a) // (x.f + y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, a, unnest([array_to_string(w[i:i + z - 1], ' ') FOR i IN range(1, size - z + 2)]) AS phrase FROM c, range(2, 4) t(z) WHERE z < size),
o AS (SELECT lang, phrase, max(a) AS longer FROM d GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)::BIGINT AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {"op8_decontamination": _OP8, "op11_collocations": _OP11}
