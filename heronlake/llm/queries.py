"""Queries of the training-data operators: each callable takes a session and a data folder."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cutting, leaks, mixing, packing, pairs, pii, sentences, splits
from .common import table


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return splits.place_keys(table(spark, d, "user_feedback"), table(spark, d, "split_share"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_sessions(_placed(spark, d))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return splits.unit_members(_placed(spark, d))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "user_feedback"), table(spark, d, "split_share")).select("feedback_id", "session_id", "question_id", "split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    shares = table(spark, d, "split_share")
    return splits.split_report(splits.assign_splits(table(spark, d, "user_feedback"), shares), shares)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pairs_of(table(spark, d, "qa_pair"), table(spark, d, "ragas_standard_tinyllama_10"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(_pairs(spark, d)).where("defect is not null").select("src_table", "pair_key", "defect").distinct()


def p2_defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(_pairs(spark, d)).groupBy("src_table", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("rows"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "kb_chunk"), table(spark, d, "test_set_eval30")).select("chunk_pk", "test_id").distinct()


def p3_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    hits = leaks.leaked_passages(table(spark, d, "kb_chunk"), table(spark, d, "test_set_eval30"))
    return hits.groupBy("test_id").agg(F.count_distinct("chunk_pk").alias("chunks"), F.max("run").alias("longest_run"), F.max("share").alias("largest_share"))


def p3_near(spark: SparkSession, d: str) -> DataFrame:
    return leaks.near_passages(table(spark, d, "kb_chunk"), table(spark, d, "test_set_eval30"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return cutting.cut_items(table(spark, d, "kb_chunk"), table(spark, d, "chunk_limit"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # a chunk is too long where the operator makes a second piece of it
    return _cut(spark, d).where("piece_no = 1").select("chunk_pk").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).select("chunk_pk", "parent_id", "source", "piece_no", "piece_start", "piece_end", "chunk_id", "total_chunks", "content")


def _pii_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = (("user_feedback", "feedback_id", "feedback_text"), ("response_trajectory", "response_id", "question"), ("qa_pair", "pair_id", "question"))
    out = None
    for name, key, text in parts:
        one = table(spark, d, name).select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
        out = one if out is None else out.unionAll(one)
    # the secret comes from the session; without one a new one links values within this run only
    key = spark.conf.get("spark.heronlake.pii.key", None) or secrets.token_hex(32)
    return pii.with_pii(out, "text", table(spark, d, "given_name"), key)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pii_sources(spark, d).where("row_key is not null").select("src_table", "row_key", F.explode("pii_types").alias("pii_type")).distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _pii_sources(spark, d).select("src_table", "row_key", "redacted", "pii_types")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_size"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(p6_pack(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p7_mix(spark, d), table(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"), with_text=False).select("doc_id", "sent_start", "sent_end")


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_members, p1_splits, p1_shares, p2_found, p2_defects, p3_found, p3_leaked_items, p3_near, p4_found, p4_pieces, p5_found, p5_redacted, p6_pack, p6_report, p7_mix, p7_report, p8_found, p8_sentences)}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say; the rest is tested against brute force in ``tests/llm``."""
    return {
        "p1_found": r"""
            WITH RECURSIVE clean AS (
              SELECT DISTINCT lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')) s, lower(regexp_replace(question_id, '^\s+|\s+$', '', 'g')) q FROM user_feedback),
            e AS (SELECT * FROM clean WHERE s <> '' AND q <> ''),
            near AS (SELECT DISTINCT a.s a, b.s b FROM e a JOIN e b USING (q) WHERE a.s <> b.s),
            reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
            SELECT a AS session_a, b AS session_b FROM reach WHERE a < b""",
        "p4_found": r"""
            WITH k AS (SELECT chunk_pk, content, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) s FROM kb_chunk),
            m AS (SELECT chunk_pk, any_value(content) AS content, max(l.max_chars) AS own FROM k LEFT JOIN chunk_limit l ON l.source_kind <> 'default' AND starts_with(k.s, l.source_kind) GROUP BY chunk_pk)
            SELECT chunk_pk FROM m WHERE length(content) > coalesce(own, (SELECT max_chars FROM chunk_limit WHERE source_kind = 'default'))""",
    }
