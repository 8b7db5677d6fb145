"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from docspark.llm import bm25_search, chat_format, exact_dedup, line_dedup, mixing, near_dedup, packing, quality, secret_scan, source_divergence, token_counts, token_store, vector_codes
from docspark.llm.common import read


def queries() -> dict:
    docs = lambda spark, d: read(spark, d, "documents")
    return {
        "op1_bm25_search": lambda spark, d: bm25_search.query(spark, docs(spark, d)),
        "op2_token_store": lambda spark, d: token_store.query(spark, docs(spark, d)),
        "op3_secret_scan": lambda spark, d: secret_scan.query(spark, docs(spark, d)),
        "op4_near_dedup": lambda spark, d: near_dedup.query(spark, docs(spark, d)),
        "op5_chat_format": lambda spark, d: chat_format.query(spark, read(spark, d, "conversations")),
        "op6_hilbert_packing": lambda spark, d: packing.query(spark, docs(spark, d)),
        "op7_mix_sources": lambda spark, d: mixing.query(spark, docs(spark, d)),
        "op8_exact_dedup": lambda spark, d: exact_dedup.dedup_exact(spark, docs(spark, d)),
        "op9_quality": lambda spark, d: quality.query(spark, docs(spark, d), read(spark, d, "labels")),
        "op10_line_dedup": lambda spark, d: line_dedup.query(spark, docs(spark, d)),
        "op11_source_divergence": lambda spark, d: source_divergence.query(spark, docs(spark, d)),
        "op12_token_counts": lambda spark, d: token_counts.query(spark, docs(spark, d)),
        "op13_vector_codes": lambda spark, d: vector_codes.query(spark, read(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_bm25_search": bm25_search.ORACLE_SQL,
        "op3_secret_scan": secret_scan.ORACLE_SQL,
        "op4_near_dedup": near_dedup.ORACLE_SQL,
        "op5_chat_format": chat_format.ORACLE_SQL,
        "op7_mix_sources": mixing.ORACLE_SQL,
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
        "op10_line_dedup": line_dedup.ORACLE_SQL,
        "op11_source_divergence": source_divergence.ORACLE_SQL,
        "op13_vector_codes": vector_codes.ORACLE_SQL,
    }
