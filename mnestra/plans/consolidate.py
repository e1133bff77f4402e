"""Session consolidation: text, facts, merges, contradictions, triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnestra.operators import vectors
from mnestra.operators.store import Snapshot, rows_of, session_rows
from mnestra.schema import CONTRADICTION_CANDIDATES, MERGE_CANDIDATES, MERGE_SIMILARITY, SESSION_CAP


def session_text(memories: DataFrame, session: str, cap: int = SESSION_CAP) -> DataFrame:
    """One row ``text``: ``- [type] content`` lines of a session by falling importance; at most ``cap`` of them."""
    line = F.concat(F.lit("- ["), "memory_type", F.lit("] "), F.coalesce("content", F.lit("")))
    rows = session_rows(memories, session, cap).select("rank", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("text"))


def contradiction_candidates(memories: DataFrame | Snapshot, live: DataFrame, facts: Sequence[tuple[str, str, Sequence[float]]], k: int = CONTRADICTION_CANDIDATES) -> DataFrame:
    """``(fact, ordinal, id, content)``: visible rows among each fact's k nearest whose content differs, numbered from 1.

    ``facts`` are ``(name, content, vector)``, those of one session.
    """
    top = vectors.nearest(live, [(n, v) for n, _, v in facts], k)
    named = live.sparkSession.createDataFrame([(str(n), c) for n, c, _ in facts], "fact string, fact_content string")
    rows = rows_of(memories, top.withColumnRenamed("query", "fact")).select("fact", "rank", "id", "content").join(named, "fact")
    rows = rows.where(F.trim(F.coalesce("content", F.lit(""))) != F.trim(F.coalesce("fact_content", F.lit(""))))
    return rows.select("fact", F.row_number().over(W.partitionBy("fact").orderBy("rank")).alias("ordinal"), "id", "content")


def merge_candidates(memories: DataFrame | Snapshot, live: DataFrame, facts: Sequence[tuple[str, Sequence[float]]], k: int = MERGE_CANDIDATES) -> DataFrame:
    """``(fact, rank, id, similarity, visible)``: each fact's k nearest stored vectors, those of hidden or absent rows marked.

    The hits' side is at most k rows for each of a session's facts.
    """
    top = vectors.nearest(live, facts, k)
    seen = rows_of(memories, top.select("id").distinct()).select("id", F.lit(True).alias("seen"))
    return top.join(seen, "id", "left").select(F.col("query").alias("fact"), "rank", "id", "similarity", F.coalesce("seen", F.lit(False)).alias("visible"))


def first_target(candidates: Sequence[tuple[float, str, bool]], similarity: float = MERGE_SIMILARITY, k: int = MERGE_CANDIDATES) -> str | None:
    """The rule of a merge for one fact: of the k most similar ``(similarity, id, visible)`` the first that is visible and above the bound; ties go to the smaller id."""
    nearest = sorted(candidates, key=lambda c: (-c[0], c[1]))[:k]
    return next((id for s, id, seen in nearest if s > similarity and seen), None)


def merge_targets(memories: DataFrame | Snapshot, live: DataFrame, facts: Sequence[tuple[str, Sequence[float]]], similarity: float = MERGE_SIMILARITY, k: int = MERGE_CANDIDATES) -> DataFrame:
    """``(fact, id, similarity)``: each fact's first visible row among its k nearest that is more similar than the bound: ``first_target`` as a plan."""
    rows = merge_candidates(memories, live, facts, k).where(F.col("visible") & (F.col("similarity") > similarity))
    first = rows.groupBy("fact").agg(F.min(F.struct("rank", "id", "similarity")).alias("m"))
    return first.select("fact", "m.id", "m.similarity")


def merge_report(memories: DataFrame | Snapshot, live: DataFrame, facts: Sequence[tuple[str, Sequence[float]]], similarity: float = MERGE_SIMILARITY) -> DataFrame:
    """One row ``(new_facts, updated_facts)`` of facts that don't touch each other."""
    named = live.sparkSession.createDataFrame([(str(n),) for n, _ in facts], "fact string").join(merge_targets(memories, live, facts, similarity), "fact", "left")
    return named.agg(F.count_if(F.col("id").isNull()).alias("new_facts"), F.count_if(F.col("id").isNotNull()).alias("updated_facts"))
