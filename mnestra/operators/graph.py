"""The triple store: pattern match, entities, first-wins insertion, provenance checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnestra.sources.tables import ensure_checkpoint_dir, reference_key


def triples(raw: DataFrame) -> DataFrame:
    """One row for each triple_id, memory ids in comparable form (null for blank)."""
    return raw.withColumn("memory_id", reference_key(F.col("memory_id"))).dropDuplicates(["triple_id"])


def unique_triples(rows: DataFrame) -> DataFrame:
    """The first of equal (subject, predicate, object); later ones are ignored."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy("subject", "predicate", "object").orderBy("triple_id"))).where("_k = 1").drop("_k")


def match(rows: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:
    """Triples equal in every given part; without any, all."""
    for name, value in (("subject", subject), ("predicate", predicate), ("object", object)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def about(rows: DataFrame, entity: str) -> DataFrame:
    return rows.where((F.col("subject") == entity) | (F.col("object") == entity))


def mentions(rows: DataFrame) -> DataFrame:
    """``(name, n)``: how often a name stands as subject or object; null is none."""
    names = rows.select(F.col("subject").alias("name")).unionAll(rows.select("object"))
    return names.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))


def known_entities(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, known)``: whether each of ``names`` ``(name)`` is a subject; null names are none."""
    subjects = rows.select(F.col("subject").alias("name")).where("name IS NOT NULL").distinct().withColumn("known", F.lit(True))
    return names.select("name").where("name IS NOT NULL").distinct().join(subjects, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"))


def recent_entities(rows: DataFrame, limit: int = 20) -> DataFrame:
    """``(rank, name, created_at)``: names of subjects and objects, newest first.

    A name counts where it is met first: its earliest subject row, else its earliest object row. Ties
    by subject before object, then triple_id. Null names are none.
    """
    arms = rows.select(F.col("subject").alias("name"), F.lit(0).alias("arm"), "triple_id", "created_at").unionByName(rows.select(F.col("object").alias("name"), F.lit(1).alias("arm"), "triple_id", "created_at"))
    first = arms.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("arm", "triple_id", "created_at")).alias("f"))
    order = [F.desc("created_at"), F.asc("arm"), F.asc("triple_id"), F.asc("name")]
    top = first.select("name", "f.created_at", "f.arm", "f.triple_id").orderBy(*order).limit(limit)
    return top.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "name", "created_at")


def with_known_memory(rows: DataFrame, memories: DataFrame) -> DataFrame:
    """Triples whose memory exists, archived ones included; null memory ids pass."""
    known = memories.select(F.col("id").alias("memory_id"))
    return rows.where("memory_id IS NULL").unionByName(rows.where("memory_id IS NOT NULL").join(known, "memory_id", "left_semi").select(rows.columns))


def without_memories(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Triples left when memories are deleted; null memory ids stay."""
    return rows.join(deleted.select(F.col("id").alias("memory_id")).where("memory_id IS NOT NULL"), "memory_id", "left_anti").select(rows.columns)


def chain(rows: DataFrame, start: str, predicate: str = "next_step", most: int | None = None) -> DataFrame:
    """``(step, subject, object)``: steps that follow ``start`` along a predicate, each triple once, at its first step.

    Steps are followed until there is no new subject, so a cycle ends; a ValueError if steps go on beyond ``most``.
    Each step's triples are checkpointed.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    edges = match(rows, predicate=predicate).select("subject", "object").distinct()
    found = level = edges.where(F.col("subject") == start).select(F.lit(1).alias("step"), "subject", "object").checkpoint()
    step = 1
    while not level.isEmpty():
        step += 1
        ahead = level.select(F.col("object").alias("subject")).distinct().join(found.select("subject").distinct(), "subject", "left_anti")
        level = edges.join(ahead, "subject").select(F.lit(step).alias("step"), "subject", "object").checkpoint()
        if most is not None and step > most and not level.isEmpty():
            raise ValueError(f"more than {most} steps follow {start!r}")
        found = found.unionByName(level).checkpoint()
    return found
