"""The record store: current rows, listing, statistics, decay, and the fold of the operation log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnestra.functions.scalars import all_tags, clamp, parse_memory_type
from mnestra.operators.skew import join_unique
from mnestra.schema import DECAY_FLOOR, FORGET_DECAY, SESSION_CAP
from mnestra.sources.tables import reference_key


def current(memories: DataFrame) -> DataFrame:
    """The row of greatest insert_seq of each id, decoded leniently.

    Ids are compared without outer blanks and case; null and blank ones are left out. Null tags and
    null members become none, an unknown type a fact, a null archived flag false. Rows of one id and insert_seq are one version
    delivered again; should they differ, that with the greatest content counts, and where the caller has dropped
    the content, so that no text is read or moved, that of the latest updated_at and greatest importance.
    """
    rows = memories.withColumn("id", reference_key(F.col("id"))).where("id IS NOT NULL")
    ties = [F.desc("content")] if "content" in memories.columns else [F.desc_nulls_last("updated_at"), F.desc_nulls_last("importance")]
    newest = rows.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy(F.desc_nulls_last("insert_seq"), *ties))).where("_k = 1").drop("_k")
    return newest.withColumns(
        {
            "tags": F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()),
            "memory_type": parse_memory_type(F.col("memory_type")),
            "archived": F.coalesce("archived", F.lit(False)),
        }
    )


class Snapshot:
    """The current rows of a table: all of them, or those of a few ids, found before rows are folded, so that no other row moves."""

    def __init__(self, memories: DataFrame):
        self.raw = memories

    def all(self) -> DataFrame:
        return current(self.raw)

    def of(self, ids: DataFrame) -> DataFrame:
        """Rows of ``ids`` ``(id)``, a bounded number, which is sent to the rows."""
        keyed = self.raw.withColumn("id", reference_key(F.col("id")))
        return current(keyed.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi"))


def rows_of(memories: DataFrame | Snapshot, ids: DataFrame) -> DataFrame:
    """Visible current rows joined to ``ids``, which has a bounded number of rows, an ``id`` and what goes with it."""
    rows = memories.of(ids) if isinstance(memories, Snapshot) else memories
    return visible(rows).join(F.broadcast(ids), "id")


def visible(memories: DataFrame) -> DataFrame:
    return memories.where("NOT archived")


def get(memories: DataFrame, id: str) -> DataFrame:
    """The visible row of an id, or none."""
    return visible(memories).where(F.col("id") == reference_key(F.lit(id)))


def list_memories(memories: DataFrame, tags: Sequence[str] = (), memory_type: str | None = None, since: str | None = None, limit: int = 100, compat_like: bool = False) -> DataFrame:
    """Visible rows that have all tags, the type, and aren't older than ``since``, with their ``rank``.

    By falling importance, then creation time; ties by insert_seq. Nulls go last. A top-k per task,
    then of these: no sort of all rows.
    """
    rows = visible(memories).where(all_tags(F.col("tags"), tags, compat_like))
    if memory_type is not None:
        rows = rows.where(F.col("memory_type") == memory_type)
    if since is not None:
        rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    order = [F.desc_nulls_last("importance"), F.desc_nulls_last("created_at"), F.asc("insert_seq")]
    return ranked(rows.orderBy(*order).limit(limit), *order)


def ranked(rows: DataFrame, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """``rank`` from 1 in the given order; without ``by`` only for rows already limited."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def session_rows(memories: DataFrame, session: str, cap: int = SESSION_CAP) -> DataFrame:
    """Rows of a session among the ``cap`` most important of all; others are lost to it by definition."""
    return list_memories(memories, limit=cap).where(F.col("source_session") == session)


def stats(memories: DataFrame) -> DataFrame:
    """One row: total_memories, avg_importance (0 if empty), by_type, db_size_bytes (always 0). One pass."""
    by_type = visible(memories).groupBy("memory_type").agg(F.count("*").alias("n"), F.sum("importance").alias("s"), F.count("importance").alias("c"))
    return by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_memories"),
        F.coalesce(F.sum("s") / F.sum("c"), F.lit(0.0)).alias("avg_importance"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("memory_type", "n")))).alias("by_type"),
        F.lit(0).cast("long").alias("db_size_bytes"),
    )


def stats_by_type(memories: DataFrame) -> DataFrame:
    return visible(memories).groupBy("memory_type").agg(F.count("*").alias("n"))


def apply_decay(memories: DataFrame, factor: float) -> DataFrame:
    """All rows; of visible ones above the floor the decay score times (factor + importance / 20)."""
    due = ~F.col("archived") & (F.col("decay_score") > DECAY_FLOOR)
    return memories.withColumn("decayed", F.coalesce(due, F.lit(False))).withColumn("decay_score", F.when(due, F.col("decay_score") * (F.lit(factor) + F.col("importance") / 20.0)).otherwise(F.col("decay_score")))


def eligible(memories: DataFrame, least_importance: float | None = None, most_decay: float | None = None) -> DataFrame:
    """Visible rows under an importance and a decay score: what may be archived. Nulls don't count."""
    rows = visible(memories)
    if least_importance is not None:
        rows = rows.where(F.col("importance") < least_importance)
    return rows if most_decay is None else rows.where(F.col("decay_score") < most_decay)


def forget_by_decay(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows; of visible ones named in ``ids`` the decay score times 0.1."""
    named = ids.select(reference_key(F.col("id")).alias("id")).where("id IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    return memories.join(named, "id", "left").withColumn("decay_score", F.when(F.col("_hit") & ~F.col("archived"), F.col("decay_score") * FORGET_DECAY).otherwise(F.col("decay_score"))).drop("_hit")


def insert_records(memories: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(stored, rejected)``: new rows whose id is unknown, and those whose id is taken; of equal new ids the first stays."""
    new = new.withColumn("id", reference_key(F.col("id"))).withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("insert_seq")))
    taken = memories.select("id").distinct().withColumn("_taken", F.lit(True))
    judged = new.join(taken, "id", "left")
    good = (F.col("_k") == 1) & F.col("_taken").isNull()
    return judged.where(good).drop("_k", "_taken"), judged.where(~good).drop("_k", "_taken")


def update_records(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial updates ``(id, content, importance, tags, at)`` of visible rows; a null field keeps the old value.

    Importance is clamped and updated_at set. Several changes of an id count in order of ``at``, the
    last stated value of each field wins.
    """
    order = W.partitionBy("id").orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fields = ["content", "importance", "tags"]
    changes = changes.withColumn("id", reference_key(F.col("id"))).where("id IS NOT NULL")
    folded = changes.select("id", *[F.last(c, ignorenulls=True).over(order).alias(f"new_{c}") for c in fields], F.last("at").over(order).alias("new_at")).distinct()
    joined = memories.join(folded, "id", "left")
    hit = F.col("new_at").isNotNull() & ~F.col("archived")
    put = lambda c, new: F.when(hit, F.coalesce(new, F.col(c))).otherwise(F.col(c))
    return joined.withColumns({"content": put("content", F.col("new_content")), "importance": put("importance", clamp(F.col("new_importance"))), "tags": put("tags", F.col("new_tags")), "updated_at": put("updated_at", F.col("new_at"))}).drop("new_content", "new_importance", "new_tags", "new_at")


def max_merge(memories: DataFrame, facts: DataFrame) -> DataFrame:
    """``(id, content, importance)``: rows merged with the facts ``(id, content, importance)`` found to repeat them.

    The fact's content replaces the row's; the greater importance stays.
    """
    best = facts.groupBy("id").agg(F.max_by("content", F.struct("importance", "content")).alias("fact_content"), F.max("importance").alias("fact_importance"))
    return visible(memories).join(best, "id").select("id", F.col("fact_content").alias("content"), F.greatest("importance", "fact_importance").alias("importance"))


def fold_oplog(oplog: DataFrame) -> DataFrame:
    """The state each id has after all operations, in order of seq: one row for each id that exists.

    insert makes the row anew (importance = value, decay score 1); update sets importance (clamped;
    null keeps it) and updated_at; decay multiplies the decay score by a value from 0 to 1 (others keep it); archive
    hides it and sets updated_at; delete removes it with all before. Operations on an id before its insert or
    after a delete do nothing. Equal rows count once. Null and blank ids are left out.

    Deletes and inserts cut an id's history; what counts begins at its last insert, so two
    aggregations with partial sums and a join that spares hot ids give the state without a loop.
    """
    log = oplog.select("seq", "ts", reference_key(F.col("id")).alias("id"), F.lower(F.trim("op")).alias("op"), "value").where("id IS NOT NULL")
    ends = log.groupBy("id").agg(F.max(F.when(F.col("op").isin("insert", "delete"), F.struct("seq", "op"))).alias("cut")).where("cut.op = 'insert'").select("id", F.col("cut.seq").alias("born"))
    live = join_unique(log, ends, "id").where("seq >= born").distinct()  # of what counts only, not of the whole log
    at = F.struct("seq", F.col("value").alias("v"))
    state = live.groupBy("id").agg(
        F.max("born").alias("inserted_seq"),
        F.max(F.when(F.col("op") == "insert", F.col("ts"))).alias("created_at"),
        F.max(F.when(F.col("op").isin("insert", "update", "archive"), F.struct("seq", "ts"))).alias("touched"),
        F.max(F.when(F.col("op").isin("insert", "update") & F.col("value").isNotNull(), at)).alias("importance"),
        F.product(F.when((F.col("op") == "decay") & F.col("value").between(0.0, 1.0), F.col("value")).otherwise(1.0)).alias("decay_score"),
        F.bool_or(F.col("op") == "archive").alias("archived"),
        F.count("*").alias("n_ops"),
    )
    return state.select("id", "inserted_seq", "created_at", F.col("touched.ts").alias("updated_at"), clamp(F.coalesce("importance.v", F.lit(5.0))).alias("importance"), F.round("decay_score", 9).alias("decay_score"), "archived", "n_ops")
