"""Problem 5: references to records that do not exist, are deleted, or arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.operators.skew import HOT_SHARE
from mnestra.sources.tables import reference_key, table

#: Parts into which the references of a hot key are dealt.
SALTS = 64


def validity(parents: DataFrame, deletes: DataFrame) -> DataFrame:
    """``(parent, key, valid_from, valid_to, ended)``: the interval [valid_from, valid_to) in which a key can be referred to.

    ``parents`` has ``(parent, key, valid_from)`` rows that stand, ``deletes`` has ``(parent, key, seq, at)``. The interval of
    a key that stands begins with its earliest row and is open. That of a key of which only deletes are known
    has ended, at the time of the delete of greatest seq (null if it has none); its beginning isn't known. Null keys are left out.
    """
    kind = parents.schema["valid_from"].dataType
    rows = parents.select("parent", "key", "valid_from", F.lit(True).alias("stands"), F.lit(None).cast("struct<seq:bigint,at:timestamp_ntz>").alias("gone")).unionByName(
        deletes.select("parent", "key", F.lit(None).cast(kind).alias("valid_from"), F.lit(False).alias("stands"), F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("at").cast("timestamp_ntz").alias("at")).alias("gone"))
    )
    spans = rows.where("key IS NOT NULL").groupBy("parent", "key").agg(F.min("valid_from").alias("valid_from"), F.max("stands").alias("stands"), F.max("gone").alias("gone"))
    return spans.select("parent", "key", "valid_from", F.when(~F.col("stands"), F.col("gone.at")).alias("valid_to"), (~F.col("stands")).alias("ended"))


def orphan_references(refs: DataFrame, parents: DataFrame, deletes: DataFrame) -> DataFrame:
    """``(src_table, row_key, reason, ref_month)`` of references that don't hold.

    ``refs`` has ``(src_table, row_key, parent, key, ref_time)``. ``reason``: `missing` if the key has no
    interval of validity, `deleted` if its interval has ended, `late` if it begins
    after ``ref_time``. Null keys refer to nothing; with a null time on either side nothing is late;
    ``ref_month`` of a null time is null. Equal rows count once.

    References and validity rows are co-partitioned by key, sorted and merged in one pass. The
    references of a hot key are dealt over ``SALTS`` parts and its validity row is repeated in each.
    Hot keys come from counts combined before their shuffle; there are under ``HOT_SHARE`` of them.
    """
    refs = refs.select("src_table", "row_key", "parent", "key", "ref_time").where("key IS NOT NULL")
    counted = refs.groupBy("parent", "key").agg(F.count("*").alias("n"))
    hot = counted.where(F.col("n") * HOT_SHARE > refs.agg(F.count("*").alias("n")).scalar()).select("parent", "key", F.lit(True).alias("hot"))
    salted = refs.join(F.broadcast(hot), ["parent", "key"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_key", "ref_time"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    spans = validity(parents, deletes).join(F.broadcast(hot), ["parent", "key"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    merged = salted.hint("merge").join(spans, ["parent", "key", "salt"], "left")
    reason = F.when(F.col("ended").isNull(), "missing").when(F.col("ended"), "deleted").when(F.col("valid_from") > F.col("ref_time"), "late")
    return merged.select("src_table", "row_key", reason.alias("reason"), F.date_format("ref_time", "yyyy-MM").alias("ref_month")).where("reason IS NOT NULL").distinct()


def _parents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    memories, sessions = table(spark, sf_dir, "memories"), table(spark, sf_dir, "sessions")
    parents = memories.select(F.lit("memories").alias("parent"), reference_key(F.col("id")).alias("key"), F.col("created_at").alias("valid_from")).unionByName(
        sessions.select(F.lit("sessions").alias("parent"), reference_key(F.col("id")).alias("key"), F.col("started_at").alias("valid_from"))
    )
    deletes = table(spark, sf_dir, "oplog").where("op = 'delete'").select(F.lit("memories").alias("parent"), reference_key(F.col("id")).alias("key"), "seq", F.col("ts").alias("at"))
    return parents, deletes


def memory_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories, triples = table(spark, sf_dir, "memories"), table(spark, sf_dir, "knowledge_graph")
    refs = triples.select(F.lit("knowledge_graph").alias("src_table"), F.col("triple_id").alias("row_key"), F.lit("memories").alias("parent"), reference_key(F.col("memory_id")).alias("key"), F.col("created_at").alias("ref_time")).unionByName(
        memories.select(F.lit("memories").alias("src_table"), F.col("insert_seq").alias("row_key"), F.lit("sessions").alias("parent"), reference_key(F.col("source_session")).alias("key"), F.col("created_at").alias("ref_time"))
    )
    return orphan_references(refs, *_parents(spark, sf_dir))


def p5_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals themselves."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return validity(*_parents(spark, sf_dir)).select("parent", "key", text("valid_from"), text("valid_to"), "ended")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_references(spark, sf_dir)


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references don't hold, by table, month and reason."""
    return memory_references(spark, sf_dir).groupBy("src_table", "ref_month", "reason").agg(F.count("*").alias("n_rows"))


_FOUND_SQL = """WITH
  refs AS (SELECT 'knowledge_graph' AS src_table, triple_id AS row_key, 'memories' AS parent, lower(trim(memory_id)) AS key, created_at AS ref_time FROM knowledge_graph
    UNION ALL SELECT 'memories', insert_seq, 'sessions', lower(trim(source_session)), created_at FROM memories),
  parents AS (SELECT parent, key, min(valid_from) AS valid_from FROM (SELECT 'memories' AS parent, lower(trim(id)) AS key, created_at AS valid_from FROM memories
    UNION ALL SELECT 'sessions', lower(trim(id)), started_at FROM sessions) WHERE key <> '' GROUP BY ALL),
  gone AS (SELECT DISTINCT lower(trim(id)) AS key FROM oplog WHERE op = 'delete')
SELECT DISTINCT src_table, row_key, CASE WHEN p.key IS NOT NULL THEN 'late' WHEN g.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason, strftime(ref_time, '%Y-%m') AS ref_month
FROM refs r LEFT JOIN parents p ON p.parent = r.parent AND p.key = r.key LEFT JOIN gone g ON r.parent = 'memories' AND g.key = r.key
WHERE r.key <> '' AND (p.key IS NULL OR p.valid_from > r.ref_time)"""

_VALIDITY_SQL = """WITH p AS (SELECT 'memories' AS parent, lower(trim(id)) AS key, created_at AS f FROM memories UNION ALL SELECT 'sessions', lower(trim(id)), started_at FROM sessions),
  s AS (SELECT parent, key, min(f) AS f FROM p WHERE key <> '' GROUP BY ALL),
  g AS (SELECT lower(trim(id)) AS key, arg_max(ts, seq) AS gone_at FROM oplog WHERE op = 'delete' AND trim(id) <> '' GROUP BY 1)
SELECT parent, key, strftime(f, '%Y-%m-%d %H:%M:%S') AS valid_from, NULL AS valid_to, false AS ended FROM s
UNION ALL SELECT 'memories', key, NULL, strftime(gone_at, '%Y-%m-%d %H:%M:%S'), true FROM g WHERE key NOT IN (SELECT key FROM s WHERE parent = 'memories')"""

SQL = {"p5_validity": _VALIDITY_SQL, "p5_found": _FOUND_SQL, "p5_counts": f"SELECT src_table, ref_month, reason, count(*) AS n_rows FROM ({_FOUND_SQL}) GROUP BY ALL"}
