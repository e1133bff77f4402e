"""Hybrid search and recall as plans over the store, the vectors and the text index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnestra.functions.scalars import any_tag, parse_selected
from mnestra.operators import fts, vectors
from mnestra.operators.store import Snapshot, rows_of
from mnestra.operators.textindex import TextIndex
from mnestra.schema import RECALL_CANDIDATES, RECALL_LIMIT, SEARCH_LIMIT

RESULT = ["id", "content", "importance", "tags", "memory_type", "created_at", "source_session"]


def hits(memories: DataFrame | Snapshot, live: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """``(rank, id, similarity, row...)``: the k nearest vectors, joined to visible rows; others drop out and use up a place.

    The hits' side is at most k rows, so it is broadcast.
    """
    top = vectors.nearest(live, [("q", list(query))], k).select(F.col("rank").alias("vector_rank"), "id", "similarity")
    return rows_of(memories, top).select("vector_rank", "similarity", *RESULT)


def hybrid_search(memories: DataFrame | Snapshot, live: DataFrame, query: str, embedding: Sequence[float], limit: int = SEARCH_LIMIT, tags: Sequence[str] = (), text: TextIndex | None = None) -> DataFrame:
    """``(rank, source, id, similarity, row...)``: vector hits first, then text hits not among them (similarity 0).

    Of vectors the 2 * limit nearest count, of the text the ``limit`` best; rows without any of
    ``tags`` are dropped after that, so fewer than ``limit`` may be left. ``text`` is a stored index of the
    same rows; without one the texts themselves are searched. Of the store only the hits' rows are folded: at most 3 * limit.
    """
    near = vectors.nearest(live, [("q", list(embedding))], 2 * limit).select("id", F.lit(0).alias("source"), F.col("rank").alias("place"), "similarity")
    found = text.search(query, limit) if text is not None else fts.search(memories.all() if isinstance(memories, Snapshot) else memories, query, limit)
    worded = found.select("id", F.lit(1).alias("source"), F.col("rank").alias("place"), F.lit(0.0).alias("similarity"))
    first = near.unionByName(worded).groupBy("id").agg(F.min(F.struct("source", "place", "similarity")).alias("h")).select("id", "h.source", "h.place", "h.similarity")
    rows = rows_of(memories, first).where(any_tag(F.col("tags"), tags))
    order = [F.asc("source"), F.asc("place")]
    return rows.orderBy(*order).limit(limit).select(F.row_number().over(W.orderBy(*order)).cast("int").alias("rank"), "source", "similarity", *RESULT)


def recall_candidates(memories: DataFrame | Snapshot, live: DataFrame, embedding: Sequence[float], tags: Sequence[str] = (), since: str | None = None, memory_type: str | None = None, k: int = RECALL_CANDIDATES) -> DataFrame:
    """``(ordinal, similarity, row...)``: of the k nearest those that are visible and pass all filters, numbered from 1."""
    rows = hits(memories, live, embedding, k).where(any_tag(F.col("tags"), tags))
    if memory_type is not None:
        rows = rows.where(F.col("memory_type") == memory_type)
    if since is not None:
        rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return rows.select(F.row_number().over(W.orderBy("vector_rank")).cast("int").alias("ordinal"), "similarity", *RESULT)


def candidate_text(candidates: DataFrame) -> DataFrame:
    """One row ``text``: a numbered line for each candidate. Importance is written without a trailing zero."""
    importance = F.regexp_replace(F.col("importance").cast("string"), r"\.0$", "")
    line = F.format_string("[%d] (similarity: %.3f, importance: %s) %s", "ordinal", "similarity", importance, F.coalesce("content", F.lit("")))
    return candidates.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def selected(candidates: DataFrame, responses: DataFrame, limit: int = RECALL_LIMIT) -> DataFrame:
    """``(rank, reasoning, similarity, row...)``: candidates in the order an answer selects them.

    ``responses`` has one answer ``(response_id, response)``. Ordinals beyond the candidates are
    dropped, repeated ones kept. If nothing is selected the candidates stay in their order, without a
    reasoning. At most ``limit`` rows.
    """
    chosen = parse_selected(responses).select("ordinal", "pos", "reasoning").join(candidates, "ordinal")
    none = chosen.limit(1).agg(F.count("*").alias("n")).scalar() == 0
    kept = chosen.unionByName(candidates.where(none).withColumn("pos", F.col("ordinal")).withColumn("reasoning", F.lit(None).cast("string")))
    return kept.orderBy("pos").limit(limit).select(F.row_number().over(W.orderBy("pos")).cast("int").alias("rank"), "reasoning", "similarity", *RESULT)
