"""The registered queries of this folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import automaton, bpe, language, lexical, merkle, neighbours, packing, pii, preference, simhash, sketch, suffix, toxicity
from .common import documents, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


@query("op1_bpe_round_trip")
def _bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_pack_documents")
def _pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_simhash_golay")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query("op6_suffix_dedup")
def _suffix(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix.removed(documents(spark, folder))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_bottom_k_sketch")
def _sketch(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.compare_with_edit(documents(spark, folder))


@query("op5_boosted_pii")
def _pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return pii.span_digests(docs, pii.train(docs))


@query("op7_compression_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op9_language_families")
def _language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = language.predict(docs, language.learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op3_nn_descent")
def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


PREFERENCE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
last AS (
  SELECT conv_id, turn, max(text) AS answer FROM t
  WHERE role = 'assistant' AND (conv_id, turn) IN
    (SELECT (conv_id, max(turn)) FROM t WHERE role = 'assistant' GROUP BY conv_id)
  GROUP BY conv_id, turn),
ring AS (
  SELECT conv_id, turn, coalesce(lead(answer) OVER (ORDER BY conv_id), first(answer) OVER (ORDER BY conv_id)) AS answer
  FROM last),
other AS (
  SELECT t.conv_id, t.turn, t.role, coalesce(r.answer, t.text) AS text
  FROM t LEFT JOIN ring r ON t.conv_id = r.conv_id AND t.turn = r.turn AND t.role = 'assistant'),
fork AS (
  SELECT t.conv_id, min(CASE WHEN t.text <> o.text THEN t.turn END) AS fork
  FROM t JOIN other o ON t.conv_id = o.conv_id AND t.turn = o.turn AND t.role = o.role GROUP BY t.conv_id),
parts AS (
  SELECT t.conv_id, t.turn, t.role, t.text, CASE WHEN f.fork IS NULL OR t.turn < f.fork THEN 'prompt' ELSE 'chosen' END AS part
  FROM t JOIN fork f USING (conv_id)
  UNION ALL
  SELECT o.conv_id, o.turn, o.role, o.text, 'rejected' FROM other o JOIN fork f USING (conv_id) WHERE o.turn >= f.fork),
pieces AS (
  SELECT *, turn // 64 AS segment, '<|' || role || '|>' || chr(10) AS head,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM parts),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, segment, part ORDER BY turn, role, text) - length(piece) AS pos FROM pieces)
SELECT conv_id, segment,
  coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(piece) - 1)::BIGINT, ',' ORDER BY turn, role, text)
    FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(piece) - 1)::BIGINT, ',' ORDER BY turn, role, text)
    FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (part = 'prompt') AS n_prompt_turns
FROM placed GROUP BY conv_id, segment
"""


@query("op10_preference_pairs", PREFERENCE_SQL)
def _preference(spark: SparkSession, folder: str) -> DataFrame:
    chosen, rejected = preference.against_next(spark.read.parquet(f"{folder}/conversations.parquet"))
    return preference.preferences(chosen, rejected, "conv_id")


@query("op11_merkle_witnesses", merkle.sql())
def _merkle(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.manifest(documents(spark, folder), merkle.without_line_ends())
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_max_sketch_search", lexical.SQL)
def _search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op13_suffix_automata", automaton.SQL)
def _automata(spark: SparkSession, folder: str) -> DataFrame:
    return automaton.removed(documents(spark, folder))
