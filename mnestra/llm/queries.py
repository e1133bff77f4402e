"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnestra.llm import neighbours, pack, pairs, pii, quality, terms, tokenize


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": terms.p1_found,
        "p1_terms": terms.p1_terms,
        "p1_bitmaps": terms.p1_bitmaps,
        "p1_members": terms.p1_members,
        "p2_found": pairs.p2_found,
        "p2_pairs": pairs.p2_pairs,
        "p2_all_pairs": pairs.p2_all_pairs,
        "p3_found": neighbours.p3_found,
        "p3_neighbours": neighbours.p3_neighbours,
        "p4_found": pii.p4_found,
        "p4_redacted": pii.p4_redacted,
        "p4_counts": pii.p4_counts,
        "p6_ids": tokenize.p6_ids,
        "p7_found": pack.p7_found,
        "p7_packed": pack.p7_packed,
        "p7_containers": pack.p7_containers,
        "p7_bounded": pack.p7_bounded,
        "p7_audit": pack.p7_audit,
        "p8_found": quality.p8_found,
        "p8_statistics": quality.p8_statistics,
        "p8_counts": quality.p8_counts,
    }


def oracle_sql() -> dict[str, str]:
    return terms.SQL | pairs.SQL | pack.SQL | quality.SQL
