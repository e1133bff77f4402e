"""All queries of the core over a data directory, with the SQL each must agree with.

Times and lists leave as text so that every engine writes them alike; ranks are 64-bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.functions import embed, scalars
from mnestra.operators import graph, references, store, vectors
from mnestra.operators.textindex import TextIndex
from mnestra.plans import consolidate, retrieve
from mnestra.sources import rows as text_rows
from mnestra.sources.tables import reference_key, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# -- views both engines build alike ---------------------------------------------------------
M_SQL = """m AS (SELECT * EXCLUDE (k) FROM (SELECT lower(trim(id)) AS id, content, importance, list_filter(coalesce(tags, []), lambda t: t IS NOT NULL) AS tags,
    CASE WHEN lower(memory_type) IN ('fact', 'procedure', 'preference', 'decision') THEN lower(memory_type) ELSE 'fact' END AS memory_type, created_at, updated_at, decay_score, source_session, ttl_days,
    coalesce(archived, false) AS archived, insert_seq, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY insert_seq DESC NULLS LAST, content DESC) AS k FROM memories WHERE trim(id) <> '') WHERE k = 1)"""
V_SQL = """v AS (SELECT DISTINCT lower(trim(id)) AS id, embedding::DOUBLE[] AS e FROM vectors WHERE NOT coalesce(deleted, false) AND len(embedding) = 64 AND trim(id) <> ''
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
T_SQL = "t AS (SELECT triple_id, any_value(subject) AS subject, any_value(predicate) AS predicate, any_value(object) AS object, any_value(nullif(lower(trim(memory_id)), '')) AS memory_id, any_value(created_at) AS created_at FROM knowledge_graph GROUP BY triple_id)"
L2 = "list_sum(list_transform(list_zip(v.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def q_sql(*ids: int) -> str:
    return f"q AS (SELECT vec_id::VARCHAR AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN ({', '.join(map(str, ids))}))"


def m(spark: SparkSession, d: str) -> DataFrame:
    return store.current(table(spark, d, "memories"))


def n(spark: SparkSession, d: str) -> DataFrame:
    """Current rows without their content, for queries that don't show it."""
    return store.current(table(spark, d, "memories").drop("content"))


def snapshot(spark: SparkSession, d: str) -> store.Snapshot:
    return store.Snapshot(table(spark, d, "memories"))


def text_index(spark: SparkSession, d: str) -> TextIndex:
    """The stored index of the current memories, in the shared folder; made once for a state of the table's files."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    path = make(f"{d}/memories.parquet")
    files = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(make(f"{d}/memories.parquet{{,/*}}")))
    index = TextIndex(spark, f"{shared_folder(spark)}/mnestra-text/{hashlib.sha256(chr(10).join(files).encode()).hexdigest()[:32]}")
    if not index.generations():
        index.refresh(m(spark, d))
    return index


def v(spark: SparkSession, d: str) -> DataFrame:
    return vectors.live(table(spark, d, "vectors"))


def whole_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Live vectors with finite components, equal rows once."""
    return v(spark, d).where(vectors.finite(F.col("embedding"))).distinct()


def t(spark: SparkSession, d: str) -> DataFrame:
    return graph.triples(table(spark, d, "knowledge_graph"))


def q(spark: SparkSession, d: str, *ids: int) -> list[tuple]:
    """Query vectors: rows of embeddings with the given numbers."""
    return vectors.query_vectors(table(spark, d, "embeddings").where(F.col("vec_id").isin(*ids)))


def q1(spark: SparkSession, d: str, id: int) -> list[float]:
    """One query vector; of an empty table the zero vector."""
    found = q(spark, d, id)
    return found[0][1] if found else [0.0] * 64


def text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def rank() -> object:
    return F.col("rank").cast("long").alias("rank")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


# -- store ----------------------------------------------------------------------------------
@query(f"WITH {M_SQL} SELECT id, content, importance, array_to_string(tags, ',') AS tags, memory_type, {_time('created_at')} FROM m WHERE NOT archived AND id = (SELECT min(id) FROM m WHERE NOT archived)")
def mem_get_visible(spark, d):
    rows = m(spark, d)
    first = store.visible(rows).agg(F.min("id").alias("id")).first()["id"] or ""
    return store.get(rows, first).select("id", "content", "importance", F.array_join("tags", ",").alias("tags"), "memory_type", text("created_at"))


_LISTED = f"SELECT row_number() OVER (ORDER BY importance DESC NULLS LAST, created_at DESC NULLS LAST, insert_seq) AS rank, id, importance, {_time('created_at')}, insert_seq FROM m WHERE NOT archived"


@query(f"WITH {M_SQL} SELECT * FROM ({_LISTED} AND memory_type = 'preference' AND created_at >= '2024-01-01' AND len(list_filter(['cache'], lambda x: NOT list_contains(tags, x))) = 0) WHERE rank <= 50")
def mem_list_filtered(spark, d):
    return store.list_memories(n(spark, d), ["cache"], "preference", "2024-01-01 00:00:00", 50).select(rank(), "id", "importance", text("created_at"), "insert_seq")


@query(f"WITH {M_SQL} SELECT * FROM ({_LISTED} AND created_at >= '2024-06-01') WHERE rank <= 100")
def mem_list_since(spark, d):
    return store.list_memories(n(spark, d), since="2024-06-01 00:00:00").select(rank(), "id", "importance", text("created_at"), "insert_seq")


@query(f"WITH {M_SQL} SELECT count(*) AS total_memories, round(coalesce(avg(importance), 0), 6) AS avg_importance, 0::BIGINT AS db_size_bytes FROM m WHERE NOT archived")
def mem_stats_total(spark, d):
    return store.stats(n(spark, d)).select("total_memories", F.round("avg_importance", 6).alias("avg_importance"), "db_size_bytes")


@query(f"WITH {M_SQL} SELECT memory_type, count(*) AS n FROM m WHERE NOT archived GROUP BY memory_type")
def mem_stats_by_type(spark, d):
    return store.stats_by_type(n(spark, d))


@query(f"WITH {M_SQL} SELECT id, NOT archived AND coalesce(decay_score > 0.01, false) AS decayed, round(CASE WHEN NOT archived AND decay_score > 0.01 THEN decay_score * (0.95::DOUBLE + importance / 20) ELSE decay_score END, 9) AS decay_score FROM m")
def mem_decay_apply(spark, d):
    return store.apply_decay(n(spark, d), 0.95).select("id", "decayed", F.round("decay_score", 9).alias("decay_score"))


@query(f"WITH {M_SQL} SELECT id, round(CASE WHEN insert_seq % 7 = 0 AND NOT archived THEN decay_score * 0.1::DOUBLE ELSE decay_score END, 9) AS decay_score FROM m")
def mem_forget_decay(spark, d):
    rows = n(spark, d)
    return store.forget_by_decay(rows, rows.where("insert_seq % 7 = 0")).select("id", F.round("decay_score", 9).alias("decay_score"))


@query(f"WITH {M_SQL} SELECT id, array_to_string(tags, ',') AS tags FROM m WHERE NOT archived AND (list_contains(tags, 'cache') OR list_contains(tags, 'rust'))")
def mem_tags_any(spark, d):
    return store.visible(n(spark, d)).where(scalars.any_tag(F.col("tags"), ["cache", "rust"])).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {M_SQL} SELECT id, array_to_string(tags, ',') AS tags FROM m WHERE NOT archived AND lower(to_json(tags)) LIKE '%\"c%e\"%'")
def mem_tags_all_like(spark, d):
    return store.visible(n(spark, d)).where(scalars.all_tags(F.col("tags"), ["C%E"], compat_like=True)).select("id", F.array_join("tags", ",").alias("tags"))


_TOP_TWO = "SELECT tag FROM (SELECT unnest(tags) AS tag FROM m) GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 2"


@query(f"WITH {M_SQL}, w AS ({_TOP_TWO}) SELECT id, array_to_string(tags, ',') AS tags FROM m WHERE NOT archived AND len(list_filter((SELECT list(tag) FROM w), lambda x: NOT list_contains(tags, x))) = 0")
def mem_tags_all(spark, d):
    rows = n(spark, d)
    top = [r[0] for r in rows.select(F.explode("tags").alias("tag")).groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(2).collect()]
    return store.visible(rows).where(scalars.all_tags(F.col("tags"), top)).select("id", F.array_join("tags", ",").alias("tags"))


_SESSION = "(SELECT source_session FROM m WHERE NOT archived AND source_session IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _session(rows: DataFrame) -> str:
    hit = store.visible(rows).where("source_session IS NOT NULL").groupBy("source_session").count().orderBy(F.desc("count"), "source_session").first()
    return hit[0] if hit else ""


@query(f"WITH {M_SQL}, top AS (SELECT * FROM ({_LISTED}) WHERE rank <= 1000) SELECT top.rank, top.id, m.memory_type FROM top JOIN m USING (id) WHERE m.source_session = {_SESSION}")
def mem_session_top1000(spark, d):
    rows = n(spark, d)
    return store.session_rows(rows, _session(rows)).select(rank(), "id", "memory_type")


@query(f"WITH {M_SQL}, top AS (SELECT * FROM ({_LISTED}) WHERE rank <= 1000) SELECT string_agg('- [' || m.memory_type || '] ' || coalesce(m.content, ''), chr(10) ORDER BY rank) AS text FROM top JOIN m USING (id) WHERE m.source_session = {_SESSION}")
def session_text(spark, d):
    rows = m(spark, d)
    return consolidate.session_text(rows, _session(rows))


@query(f"""WITH {M_SQL}, n AS (SELECT DISTINCT lower(trim(id)) AS id FROM oplog WHERE op = 'insert')
SELECT n.id, m.id IS NOT NULL AS taken FROM n LEFT JOIN m ON m.id = n.id WHERE n.id <> ''""")
def mem_insert_check(spark, d):
    new = table(spark, d, "oplog").where("op = 'insert'").select(reference_key(F.col("id")).alias("id"), F.col("seq").alias("insert_seq")).where("id IS NOT NULL")
    new = new.groupBy("id").agg(F.min("insert_seq").alias("insert_seq"))
    stored, rejected = store.insert_records(n(spark, d), new)
    return stored.select("id", F.lit(False).alias("taken")).unionByName(rejected.select("id", F.lit(True).alias("taken")))


_STATE_SQL = """WITH log AS (SELECT DISTINCT seq, ts, lower(trim(id)) AS id, lower(trim(op)) AS op, value FROM oplog WHERE trim(id) <> ''),
  cut AS (SELECT id, arg_max(op, seq) AS op, max(seq) AS born FROM log WHERE op IN ('insert', 'delete') GROUP BY id),
  live AS (SELECT log.*, born FROM log JOIN cut USING (id) WHERE cut.op = 'insert' AND seq >= born)
SELECT id, any_value(born) AS inserted_seq, strftime(max(ts) FILTER (op = 'insert'), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(arg_max(ts, seq) FILTER (op IN ('insert', 'update', 'archive')), '%Y-%m-%d %H:%M:%S') AS updated_at,
  round(least(greatest(coalesce(arg_max(value, seq) FILTER (op IN ('insert', 'update') AND value IS NOT NULL), 5), 1), 10), 6) AS importance,
  round(coalesce(product(value) FILTER (op = 'decay' AND value BETWEEN 0 AND 1), 1), 6) AS decay_score, bool_or(op = 'archive') AS archived, count(*) AS n_ops
FROM live GROUP BY id"""


@query(_STATE_SQL)
def oplog_fold(spark, d):
    return store.fold_oplog(table(spark, d, "oplog")).select("id", "inserted_seq", text("created_at"), text("updated_at"), F.round("importance", 6).alias("importance"), F.round("decay_score", 6).alias("decay_score"), "archived", "n_ops")


@query(f"""WITH {M_SQL}, c AS (SELECT lower(trim(id)) AS id, arg_max(value, seq) FILTER (value IS NOT NULL) AS new, max(seq) AS seen FROM (SELECT DISTINCT * FROM oplog) WHERE op = 'update' AND trim(id) <> '' GROUP BY 1)
SELECT m.id, round(CASE WHEN seen IS NOT NULL AND NOT archived THEN coalesce(CASE WHEN new IS NOT NULL THEN least(greatest(new, 1), 10) END, importance) ELSE importance END, 6) AS importance, seen IS NOT NULL AND NOT archived AS touched FROM m LEFT JOIN c ON c.id = m.id""")
def oplog_partial_update(spark, d):
    changes = table(spark, d, "oplog").where("op = 'update'").select(reference_key(F.col("id")).alias("id"), F.lit(None).cast("string").alias("content"), F.col("value").alias("importance"), F.lit(None).cast("array<string>").alias("tags"), F.col("seq").alias("at"))
    rows = m(spark, d).withColumn("updated_at", F.lit(None).cast("long"))
    return store.update_records(rows, changes).select("id", F.round("importance", 6).alias("importance"), F.col("updated_at").isNotNull().alias("touched"))


@query(f"""WITH {M_SQL}, f AS (SELECT lower(trim(id)) AS id, max(value) AS value FROM oplog WHERE op = 'update' AND value IS NOT NULL AND trim(id) <> '' GROUP BY 1)
SELECT m.id, 'fact ' || m.id AS content, round(greatest(m.importance, f.value), 6) AS importance FROM m JOIN f ON f.id = m.id WHERE NOT archived""")
def max_merge(spark, d):
    facts = table(spark, d, "oplog").where("op = 'update' AND value IS NOT NULL").select(reference_key(F.col("id")).alias("id"), F.col("value").alias("importance")).where("id IS NOT NULL").withColumn("content", F.concat(F.lit("fact "), "id"))
    return store.max_merge(m(spark, d), facts).withColumn("importance", F.round("importance", 6))


# -- vectors --------------------------------------------------------------------------------
def _near_sql(ids: tuple[int, ...], distance: str = L2, source: str = "v") -> str:
    return f"""WITH {M_SQL}, {V_SQL}, {q_sql(*ids)}, x AS (SELECT q.query, v.id, round({distance}, 9) AS distance FROM {source}, q),
  r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank, id, distance FROM x)"""


_OUT_SQL = "SELECT query, rank, id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM r"


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("query", rank(), "id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(f"{_near_sql((3,))} {_OUT_SQL} WHERE rank <= 10")
def vec_topk(spark, d):
    return _out(vectors.nearest(v(spark, d), q(spark, d, 3), 10))


@query(f"{_near_sql((1, 2, 5, 8, 13, 21))} {_OUT_SQL} WHERE rank <= 5")
def vec_batch_topk(spark, d):
    return _out(vectors.nearest(v(spark, d), q(spark, d, 1, 2, 5, 8, 13, 21), 5))


@query(f"{_near_sql((3,), source='(SELECT v.* FROM v JOIN m USING (id) WHERE NOT archived) v')} {_OUT_SQL} WHERE rank <= 10")
def vec_topk_prefilter(spark, d):
    return _out(vectors.nearest(v(spark, d).join(store.visible(n(spark, d)).select("id"), "id", "left_semi"), q(spark, d, 3), 10))


@query(f"{_near_sql((3,))} SELECT r.rank, m.id, round(1 / (1 + distance), 6) AS similarity, m.memory_type FROM r JOIN m ON m.id = r.id WHERE rank <= 50 AND NOT archived AND memory_type = 'fact' AND created_at >= '2024-01-01'")
def vec_topk_postfilter(spark, d):
    rows = retrieve.hits(snapshot(spark, d), v(spark, d), q1(spark, d, 3), 50).where("memory_type = 'fact'").where(F.col("created_at") >= F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return rows.select(F.col("vector_rank").cast("long").alias("rank"), "id", F.round("similarity", 6).alias("similarity"), "memory_type")


@query(f"{_near_sql((3,))} {_OUT_SQL} WHERE distance <= 1.5")
def vec_range(spark, d):
    return _out(vectors.within(v(spark, d), q(spark, d, 3), 1.5, ranked=True))


_IP = "1 - list_sum(list_transform(list_zip(v.e, q.e), lambda p: p[1] * p[2]))"


@query(f"{_near_sql((3,), _IP)} SELECT query, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 10")
def vec_ip_topk(spark, d):
    return _out(vectors.nearest(v(spark, d), q(spark, d, 3), 10, "ip")).drop("similarity")


@query(f"""WITH {M_SQL}, {V_SQL}, {q_sql(3)}, x AS (SELECT m.source_session AS document, round(min({L2}), 9) AS distance FROM v JOIN m ON m.id = v.id, q WHERE m.source_session IS NOT NULL GROUP BY 1)
SELECT row_number() OVER (ORDER BY distance, document) AS rank, document, round(distance, 6) AS distance FROM x QUALIFY rank <= 10""")
def vec_multidoc(spark, d):
    docs = n(spark, d).select("id", F.col("source_session").alias("document"))
    return vectors.nearest_documents(v(spark, d), docs, q(spark, d, 3), 10).select(rank(), "document", F.round("distance", 6).alias("distance"))


@query(f"WITH {V_SQL}, x AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS n FROM v) SELECT id, round(n, 6) AS length, round(CASE WHEN n > 0 THEN e[1] / n ELSE e[1] END, 6) AS first, round(CASE WHEN n > 0 THEN e[64] / n ELSE e[64] END, 6) AS last FROM x")
def vec_normalize(spark, d):
    rows = whole_vectors(spark, d).select("id", vectors.normalised(F.col("embedding")).alias("u"), F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("n"))
    return rows.select("id", F.round("n", 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query(f"{_near_sql((1, 2, 5, 8))} SELECT query AS fact, id, round(1 / (1 + distance), 6) AS similarity FROM (SELECT r.*, row_number() OVER (PARTITION BY query ORDER BY rank) AS k FROM r JOIN m ON m.id = r.id WHERE rank <= 3 AND NOT archived AND 1 / (1 + distance) > 0.3) WHERE k = 1")
def vec_dedup_match(spark, d):
    return consolidate.merge_targets(snapshot(spark, d), v(spark, d), q(spark, d, 1, 2, 5, 8), 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"{_near_sql((1, 2, 5, 8))} SELECT query AS fact, row_number() OVER (PARTITION BY query ORDER BY rank) AS ordinal, m.id, content FROM r JOIN m ON m.id = r.id WHERE rank <= 5 AND NOT archived AND trim(coalesce(content, '')) <> 'The search gateway'")
def contradiction_candidates(spark, d):
    facts = [(n, " The search gateway ", x) for n, x in q(spark, d, 1, 2, 5, 8)]
    return consolidate.contradiction_candidates(snapshot(spark, d), v(spark, d), facts).withColumn("ordinal", F.col("ordinal").cast("long"))


# -- text -----------------------------------------------------------------------------------
_TERMS = "list_filter(regexp_split_to_array(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_DOCS = f"""docs AS (SELECT id, insert_seq, archived, {_TERMS.format("coalesce(content, '')")} || {_TERMS.format("array_to_string(tags, ' ')")} AS terms FROM m)"""


def _fts_sql(words: list[str], where: str, limit: int = 20, then: str = "SELECT rank, id, score FROM ranked") -> str:
    tf = ", ".join(f"len(list_filter(terms, lambda w: w = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    idf = [f"CASE WHEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) END" for i in range(len(words))]
    score = " + ".join(f"({w}) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))" for i, w in enumerate(idf))
    return f"""{M_SQL}, {_DOCS}, counted AS (SELECT id, insert_seq, archived, len(terms) AS length, {tf} FROM docs), totals AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM counted),
  best AS (SELECT id, insert_seq, round(-({score}), 6) AS score FROM counted, totals WHERE NOT archived AND ({where})),
  ranked AS (SELECT row_number() OVER (ORDER BY score, insert_seq) AS rank, id, score FROM best QUALIFY rank <= {limit}) {then}"""


@query(f"WITH {M_SQL}, {_DOCS}, x AS (SELECT id, unnest(terms) AS term FROM docs) SELECT term, count(DISTINCT id) AS n_docs, count(*) AS n_occurrences FROM x GROUP BY term")
def fts_terms(spark, d):
    n = F.size("content_at") + F.size("tags_at")
    return text_index(spark, d).postings().groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_occurrences"))


@query(f"WITH {M_SQL}, {_DOCS}, x AS (SELECT id, len(terms) AS length, unnest(terms) AS term FROM docs) SELECT term, id, count(*) AS tf, any_value(length)::BIGINT AS length FROM x GROUP BY term, id")
def fts_postings(spark, d):
    n = (F.size("content_at") + F.size("tags_at")).cast("long")
    return text_index(spark, d).postings().select("term", "id", n.alias("tf"), F.col("length").cast("long").alias("length"))


@query("WITH " + _fts_sql(["snapshot"], "tf0 > 0", 10**9, "SELECT id, score FROM ranked"))
def fts_bm25(spark, d):
    return text_index(spark, d).search("snapshot", None)


def _searched(rows: DataFrame) -> DataFrame:
    return rows.select(rank(), "id", "score")


@query("WITH " + _fts_sql(["queue", "monitor"], "tf0 > 0 AND tf1 > 0"))
def fts_search(spark, d):
    return _searched(text_index(spark, d).search("Queue monitor"))


@query("WITH " + _fts_sql(["broker", "export"], "tf0 > 0 OR tf1 > 0"))
def fts_search_or(spark, d):
    return _searched(text_index(spark, d).search("broker OR export"))


@query("WITH " + _fts_sql(["snapshot", "weekly"], "tf0 > 0 AND NOT tf1 > 0"))
def fts_search_not(spark, d):
    return _searched(text_index(spark, d).search("snapshot NOT weekly"))


# -- hybrid search and recall ---------------------------------------------------------------
_RESULT_SQL = "m.id, m.content, m.importance, array_to_string(m.tags, ',') AS tags, m.memory_type"


def _result(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(rank(), *more, F.round("similarity", 6).alias("similarity"), "id", "content", "importance", F.array_join("tags", ",").alias("tags"), "memory_type")


@query(
    f"""WITH {_fts_sql(["cache"], "tf0 > 0", 10, "")}, {V_SQL}, {q_sql(3)}, x AS (SELECT v.id, round({L2}, 9) AS distance FROM v, q), r AS (SELECT row_number() OVER (ORDER BY distance, id) AS rank, id, distance FROM x),
  u AS (SELECT id, 0 AS source, rank AS place, 1 / (1 + distance) AS similarity FROM r WHERE rank <= 20 UNION ALL SELECT id, 1, rank, 0 FROM ranked),
  f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, place) = 1)
SELECT row_number() OVER (ORDER BY source, place) AS rank, source, round(similarity, 6) AS similarity, {_RESULT_SQL} FROM f JOIN m ON m.id = f.id WHERE NOT archived QUALIFY rank <= 10"""
)
def hybrid_search(spark, d):
    return _result(retrieve.hybrid_search(snapshot(spark, d), v(spark, d), "cache", q1(spark, d, 3), 10, text=text_index(spark, d)), "source")


def _candidates(spark, d):
    return retrieve.recall_candidates(snapshot(spark, d), v(spark, d), q1(spark, d, 3))


_CAND_SQL = f"{_near_sql((3,))}, c AS (SELECT row_number() OVER (ORDER BY rank) AS ordinal, 1 / (1 + distance) AS similarity, m.* FROM r JOIN m ON m.id = r.id WHERE rank <= 50 AND NOT archived)"


@query(f"{_CAND_SQL} SELECT ordinal AS rank, round(similarity, 6) AS similarity, {_RESULT_SQL} FROM c m WHERE ordinal <= 8")
def recall_fallback(spark, d):
    answer = spark.createDataFrame([("r", "Mock response")], "response_id string, response string")
    return _result(retrieve.selected(_candidates(spark, d), answer))


_ANSWER = "SELECTED [3] | third first\nnoise\nSELECTED 1|plain | with bar\nSELECTED [99] | beyond\nSELECTED [1] and [2] | no\nSELECTED [3] | again"


@query(f"{_CAND_SQL}, s AS (SELECT * FROM (VALUES (1, 3, 'third first'), (2, 1, 'plain | with bar'), (3, 3, 'again')) s(rank, ordinal, reasoning)) SELECT s.rank, s.reasoning, round(similarity, 6) AS similarity, {_RESULT_SQL} FROM s JOIN c m ON m.ordinal = s.ordinal")
def recall_rerank_join(spark, d):
    answer = spark.createDataFrame([("r", _ANSWER)], "response_id string, response string")
    return _result(retrieve.selected(_candidates(spark, d), answer), "reasoning")


@query(f"{_CAND_SQL} SELECT string_agg(printf('[%d] (similarity: %.3f, importance: %s) %s', ordinal, similarity, regexp_replace(importance::VARCHAR, '[.]0$', ''), coalesce(content, '')), chr(10) ORDER BY ordinal) AS text FROM c")
def candidate_text(spark, d):
    return retrieve.candidate_text(_candidates(spark, d))


# -- graph ----------------------------------------------------------------------------------
_TOP = "(SELECT {0} FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _top(rows: DataFrame, c: str) -> str:
    hit = rows.groupBy(c).count().orderBy(F.desc("count"), c).first()
    return hit[0] if hit else ""


@query(f"WITH {T_SQL} SELECT triple_id, subject, predicate, object FROM t WHERE subject = {_TOP.format('subject')} AND predicate = {_TOP.format('predicate')}")
def kg_pattern(spark, d):
    rows = t(spark, d)
    return graph.match(rows, _top(rows, "subject"), _top(rows, "predicate")).select("triple_id", "subject", "predicate", "object")


@query(f"WITH {T_SQL} SELECT triple_id, subject, predicate, object FROM t WHERE {_TOP.format('object')} IN (subject, object)")
def kg_entity(spark, d):
    rows = t(spark, d)
    return graph.about(rows, _top(rows, "object")).select("triple_id", "subject", "predicate", "object")


@query(
    f"""WITH {T_SQL}, a AS (SELECT subject AS name, 0 AS arm, triple_id, created_at FROM t UNION ALL SELECT object, 1, triple_id, created_at FROM t),
  f AS (SELECT * FROM a WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY arm, triple_id) = 1)
SELECT row_number() OVER (ORDER BY created_at DESC, arm, triple_id, name) AS rank, name, {_time('created_at')} FROM f QUALIFY rank <= 20"""
)
def kg_recent_entities(spark, d):
    return graph.recent_entities(t(spark, d)).select(rank(), "name", text("created_at"))


@query(f"WITH {T_SQL} SELECT triple_id, subject, predicate, object FROM t QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY triple_id) = 1")
def kg_insert_ignore(spark, d):
    return graph.unique_triples(t(spark, d)).select("triple_id", "subject", "predicate", "object")


@query(f"WITH {T_SQL}, {M_SQL} SELECT triple_id, memory_id FROM t WHERE memory_id IS NULL OR memory_id IN (SELECT id FROM m)")
def kg_fk_check(spark, d):
    return graph.with_known_memory(t(spark, d), n(spark, d)).select("triple_id", "memory_id")


@query(f"WITH {T_SQL} SELECT triple_id, memory_id FROM t WHERE memory_id IS NULL OR memory_id NOT IN (SELECT lower(trim(id)) FROM oplog WHERE op = 'delete' AND trim(id) <> '')")
def kg_cascade_delete(spark, d):
    gone = table(spark, d, "oplog").where("op = 'delete'").select(reference_key(F.col("id")).alias("id"))
    return graph.without_memories(t(spark, d), gone).select("triple_id", "memory_id")


# -- line protocols -------------------------------------------------------------------------
_ONE_LINE = "replace(replace(coalesce(content, ''), chr(10), ' '), chr(13), ' ')"
_FACT = f"'FACT | ' || coalesce(memory_type, '') || ' | ' || CASE insert_seq % 4 WHEN 0 THEN '8' WHEN 1 THEN '12.5' WHEN 2 THEN 'n/a' ELSE ' 0 ' END || ' | a, ,s' || insert_seq || ' | x|y ' || {_ONE_LINE}"
_ANSWERS = f"""SELECT insert_seq AS response_id,
  CASE insert_seq % 3 WHEN 0 THEN 'TRIPLE | s' || insert_seq || ' | next_step | o|p' || chr(10) WHEN 1 THEN 'TRIPLE | a | b' || chr(10) ELSE 'TRIPLE | first | is | lost' || chr(10) || 'TRIPLE | last | is | kept' || chr(10) END
  || {_FACT} || chr(10) || 'FACT | bogus | 7' || chr(10) || CASE WHEN insert_seq % 2 = 0 THEN 'FACT | Decision | 1e1 | | second' || chr(10) ELSE '' END || 'TRIPLE | trailing | is | dropped' AS response FROM latest"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories").groupBy("insert_seq").agg(F.min("memory_type").alias("memory_type"), F.min("content").alias("content"))
    return spark.sql(_ANSWERS.replace("FROM latest", "FROM {latest}").replace("{latest}", "{rows}"), rows=rows)


_FIRST = "latest AS (SELECT insert_seq, min(memory_type) AS memory_type, min(content) AS content FROM memories GROUP BY insert_seq)"
_PARSED = f"""WITH {_FIRST},
  one AS (SELECT insert_seq AS response_id, CASE insert_seq % 3 WHEN 2 THEN 2 ELSE 1 END AS pos, CASE WHEN lower(memory_type) IN ('fact', 'procedure', 'preference', 'decision') THEN lower(memory_type) ELSE 'fact' END AS memory_type,
    CASE insert_seq % 4 WHEN 0 THEN 8 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 1 END::DOUBLE AS importance, 'a,s' || insert_seq AS tags, trim('x|y ' || {_ONE_LINE}) AS content,
    CASE insert_seq % 3 WHEN 0 THEN 's' || insert_seq WHEN 2 THEN 'last' END AS subject, CASE insert_seq % 3 WHEN 0 THEN 'next_step' WHEN 2 THEN 'is' END AS predicate, CASE insert_seq % 3 WHEN 0 THEN 'o|p' WHEN 2 THEN 'kept' END AS object FROM latest),
  two AS (SELECT insert_seq, CASE insert_seq % 3 WHEN 2 THEN 4 ELSE 3 END, 'decision', 10::DOUBLE, '', 'second', NULL, NULL, NULL FROM latest WHERE insert_seq % 2 = 0),
  facts AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""


@query(f"{_PARSED} SELECT response_id, pos, memory_type, importance, tags, content FROM facts")
def parse_facts(spark, d):
    return scalars.parse_facts(_answers(spark, d)).select("response_id", "pos", "memory_type", "importance", F.array_join("tags", ",").alias("tags"), "content")


@query(f"{_PARSED} SELECT response_id, pos, subject, predicate, object FROM facts WHERE subject IS NOT NULL")
def parse_triples(spark, d):
    return scalars.parse_triples(_answers(spark, d))


@query("""SELECT insert_seq AS response_id, 0 AS pos, insert_seq % 60 AS ordinal, 'because | ' || insert_seq AS reasoning FROM (SELECT DISTINCT insert_seq FROM memories) WHERE insert_seq % 3 < 2""")
def parse_selected(spark, d):
    line = F.when(F.col("insert_seq") % 3 == 0, F.format_string(" SELECTED [%d] | because | %d ", F.col("insert_seq") % 60, "insert_seq")).when(F.col("insert_seq") % 3 == 1, F.format_string("SELECTED %d|because | %d", F.col("insert_seq") % 60, "insert_seq")).otherwise("SELECTED [1] and [2] | no")
    return scalars.parse_selected(table(spark, d, "memories").select("insert_seq").distinct().select(F.col("insert_seq").alias("response_id"), line.alias("response")))


@query("""SELECT insert_seq AS response_id, 0 AS pos, insert_seq % 9 AS ordinal, 'why | ' || insert_seq AS explanation FROM (SELECT DISTINCT insert_seq FROM memories) WHERE insert_seq % 4 < 2""")
def parse_contradiction(spark, d):
    n = F.col("insert_seq")
    line = F.when(n % 4 == 0, F.format_string("CONTRADICTION | [CANDIDATE-%d] | why | %d", n % 9, n)).when(n % 4 == 1, F.format_string("CONTRADICTION | %d | why | %d", n % 9, n)).when(n % 4 == 2, "CONTRADICTION | one | w").otherwise("NONE")
    return scalars.parse_contradictions(table(spark, d, "memories").select("insert_seq").distinct().select(n.alias("response_id"), line.alias("response")))


_SCORES = ["8", " 7.5 ", "8/10", "1d", "NaN", "-3", "99", "1e1", "", ".5", "5."]


@query(f"SELECT insert_seq AS id, CASE insert_seq % {len(_SCORES)} WHEN 0 THEN 8 WHEN 1 THEN 7.5 WHEN 5 THEN 1 WHEN 6 THEN 10 WHEN 7 THEN 10 WHEN 9 THEN 1 ELSE 5 END::DOUBLE AS score FROM (SELECT DISTINCT insert_seq FROM memories)")
def parse_score(spark, d):
    rows = table(spark, d, "memories").select("insert_seq").distinct()
    return rows.select(F.col("insert_seq").alias("id"), scalars.parse_score(F.array(*map(F.lit, _SCORES))[(F.col("insert_seq") % len(_SCORES)).cast("int")]).alias("score"))


@query("SELECT DISTINCT subject, trim(trim(' \"' || subject || '\" '), '\"') AS clean FROM knowledge_graph")
def entity_clean(spark, d):
    rows = table(spark, d, "knowledge_graph").select("subject").distinct()
    return rows.select("subject", scalars.clean_entity(F.concat(F.lit(' "'), "subject", F.lit('" '))).alias("clean"))


@query(f"WITH {M_SQL}, x AS (SELECT unnest(regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([[:punct:]]|[^\\s[:punct:]]+)')) AS token FROM m) SELECT token, count(*) AS n FROM x GROUP BY token")
def basic_tokens(spark, d):
    return m(spark, d).select(F.explode(scalars.basic_tokens(F.col("content"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# -- further rows of the inventory ----------------------------------------------------------
@query("SELECT count(*) AS n_vectors, count(*) FILTER (deleted) AS n_deleted FROM (SELECT DISTINCT id, embedding, deleted FROM vectors)")
def vec_index_size(spark, d):
    return vectors.index_size(table(spark, d, "vectors"))


@query(f"WITH {V_SQL} SELECT id, round(e[1], 6) AS first, len(e) AS dim FROM v WHERE id = (SELECT min(id) FROM v)")
def vec_get(spark, d):
    rows = whole_vectors(spark, d)
    one = rows.agg(F.min("id").alias("id")).first()["id"] or ""
    return vectors.get(rows, one).select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("dim"))


@query(f"""WITH {V_SQL}, n AS (SELECT id, list_transform(e, lambda x: x * 2) AS e FROM v WHERE id < '4'), u AS (SELECT id, e FROM n UNION ALL SELECT id, e FROM v WHERE id NOT IN (SELECT id FROM n))
SELECT id, round(list_sum(e), 6) AS total FROM u""")
def vec_upsert(spark, d):
    rows = whole_vectors(spark, d).select("id", "embedding", F.lit(False).alias("deleted"))
    new = rows.where("id < '4'").withColumn("embedding", F.transform("embedding", lambda x: (x * F.lit(2)).cast("float")))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.upsert(rows, new).select("id", F.round(total, 6).alias("total"))


@query(f"{_near_sql((3,), source="(SELECT * FROM v WHERE id NOT IN (SELECT lower(trim(id)) FROM oplog WHERE op = 'delete' AND trim(id) <> '')) v")} {_OUT_SQL} WHERE rank <= 10")
def vec_remove_topk(spark, d):
    gone = table(spark, d, "oplog").where("op = 'delete'").select(reference_key(F.col("id")).alias("id")).where("id IS NOT NULL")
    rows = vectors.removed(v(spark, d).withColumn("deleted", F.lit(False)), gone)
    return _out(vectors.nearest(vectors.live(rows), q(spark, d, 3), 10))


@query(f"WITH {V_SQL}, x AS (SELECT id, list_transform(e[1:8], lambda x: floor(x * 100 + 0.5)::BIGINT) AS b FROM v), o AS (SELECT b FROM x WHERE id = (SELECT min(id) FROM x)) SELECT x.id, list_sum(list_transform(list_zip(x.b, o.b), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::DOUBLE AS distance FROM x, o")
def vec_integer_l2(spark, d):
    rows = whole_vectors(spark, d).select("id", F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x.cast("double") * 100 + 0.5)).alias("embedding"))
    first = rows.orderBy("id").limit(1).collect()
    return vectors.scored(rows, [("q", list(r["embedding"])) for r in first]).select("id", "distance")


@query(f"WITH {M_SQL} SELECT id, len(tags) AS n, tags = from_json(to_json(tags), '[\"VARCHAR\"]') AS same FROM m")
def tags_json(spark, d):
    return n(spark, d).select("id", F.size("tags").cast("long").alias("n"), (scalars.tags_from_json(F.to_json("tags")) == F.col("tags")).alias("same"))


@query(f"WITH {M_SQL} SELECT id, importance, round(decay_score, 6) AS decay_score FROM m WHERE NOT archived AND importance < 4 AND decay_score < 0.9")
def mem_eligible(spark, d):
    return store.eligible(n(spark, d), 4.0, 0.9).select("id", "importance", F.round("decay_score", 6).alias("decay_score"))


@query(f"WITH {M_SQL} SELECT memory_type, count(*) AS n FROM m WHERE NOT archived AND id NOT IN (SELECT lower(trim(id)) FROM oplog WHERE op IN ('archive', 'delete') AND trim(id) <> '') GROUP BY memory_type")
def mem_after_forget(spark, d):
    gone = table(spark, d, "oplog").where("op IN ('archive', 'delete')").select(reference_key(F.col("id")).alias("id")).where("id IS NOT NULL").distinct()
    return store.stats_by_type(n(spark, d).join(gone, "id", "left_anti"))


@query(f"WITH {T_SQL}, n AS (SELECT DISTINCT object AS name FROM t WHERE object IS NOT NULL) SELECT name, name IN (SELECT subject FROM t WHERE subject IS NOT NULL) AS known FROM n")
def kg_known_entities(spark, d):
    rows = t(spark, d)
    return graph.known_entities(rows, rows.select(F.col("object").alias("name")))


@query(f"WITH {T_SQL} SELECT name, count(*) AS n FROM (SELECT subject AS name FROM t UNION ALL SELECT object FROM t) WHERE name IS NOT NULL GROUP BY name")
def kg_entity_mentions(spark, d):
    return graph.mentions(t(spark, d))


@query("WITH " + _fts_sql(["snap"], "tf0 > 0").replace("w = 'snap'", "starts_with(w, 'snap')"))
def fts_search_prefix(spark, d):
    return _searched(text_index(spark, d).search("snap*"))


_PHRASE = "len(list_filter(range(1, len({0})), lambda i: {0}[i] = 'token' AND {0}[i + 1] = 'broker'))"


@query("WITH " + _fts_sql(["token broker"], "tf0 > 0").replace("len(list_filter(terms, lambda w: w = 'token broker'))", _PHRASE.format("terms")))
def fts_search_phrase(spark, d):
    return _searched(text_index(spark, d).search('"Token broker"'))


@query(f"{_near_sql((1, 2, 5, 8))}, f AS (SELECT query, count(*) FILTER (NOT archived AND 1 / (1 + distance) > 0.3) AS n FROM r LEFT JOIN m ON m.id = r.id WHERE rank <= 3 GROUP BY query) SELECT count(*) FILTER (n = 0) AS new_facts, count(*) FILTER (n > 0) AS updated_facts FROM f")
def consolidation_counts(spark, d):
    return consolidate.merge_report(snapshot(spark, d), v(spark, d), q(spark, d, 1, 2, 5, 8), 0.3)


@query(f"{_near_sql((1, 2, 5))} {_OUT_SQL} WHERE distance <= 1.6 AND rank <= 7")
def vec_range_most(spark, d):
    return _out(vectors.within(v(spark, d), q(spark, d, 1, 2, 5), 1.6, 7))


@query(f"WITH {M_SQL} SELECT '{{' || string_agg('\"' || memory_type || '\":' || n, ',' ORDER BY memory_type) || '}}' AS by_type FROM (SELECT memory_type, count(*) AS n FROM m WHERE NOT archived GROUP BY memory_type)")
def mem_stats_map(spark, d):
    return store.stats(n(spark, d)).select(F.to_json("by_type").alias("by_type"))


@query(f"WITH {M_SQL} SELECT count(*) FILTER (NOT archived AND decay_score > 0.01) AS n_decayed, count(*) FILTER (NOT archived AND importance < 4) AS n_eligible FROM m")
def mem_affected_rows(spark, d):
    rows = n(spark, d)
    return store.apply_decay(rows, 0.95).agg(F.count_if("decayed").alias("n_decayed")).withColumn("n_eligible", store.eligible(rows, 4.0).agg(F.count("*")).scalar())


@query("SELECT insert_seq, insert_seq % 4 < 2 AS valid FROM (SELECT DISTINCT insert_seq FROM memories)")
def valid_ids(spark, d):
    rows, n = table(spark, d, "memories").select("insert_seq").distinct(), F.col("insert_seq")
    code = F.md5(n.cast("string"))
    cut = lambda a, b: F.substring(code, a, b)
    id = F.when(n % 4 == 0, code).when(n % 4 == 1, F.upper(F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)))).when(n % 4 == 2, cut(1, 31)).otherwise(F.concat(F.lit("g"), cut(1, 31)))
    return rows.select("insert_seq", text_rows.valid_id(id).alias("valid"))


@query("""SELECT insert_seq, strftime(CASE insert_seq % 4 WHEN 0 THEN c WHEN 1 THEN c - INTERVAL 2 HOUR WHEN 2 THEN c + INTERVAL 330 MINUTE END, '%Y-%m-%d %H:%M:%S') AS time
FROM (SELECT insert_seq, min(created_at) AS c FROM memories GROUP BY insert_seq)""")
def parse_times(spark, d):
    rows, n = table(spark, d, "memories").groupBy("insert_seq").agg(F.min("created_at").alias("c")), F.col("insert_seq")
    said = F.concat(F.date_format("c", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 4 == 0, "Z").when(n % 4 == 1, "+02:00").when(n % 4 == 2, "-05:30").otherwise(" o'clock"))
    return rows.select("insert_seq", F.date_format(text_rows.parse_time(said), "yyyy-MM-dd HH:mm:ss").alias("time"))


@query(f"WITH {M_SQL} SELECT insert_seq, content, round(importance, 6) AS importance, array_to_string(tags, ',') AS tags, memory_type, {_time('created_at')}, archived FROM m")
def rows_round_trip(spark, d):
    """Written as text and decoded again; ids become codes of the form that decoding asks for."""
    rows = m(spark, d).withColumn("id", F.md5("id"))
    back = text_rows.decode(text_rows.encode(rows))
    return back.select("insert_seq", "content", F.round("importance", 6).alias("importance"), F.array_join("tags", ",").alias("tags"), "memory_type", text("created_at"), "archived")


@query("SELECT insert_seq, array_to_string(list_transform(string_split(coalesce(source_session, '') || ', x ,,' || insert_seq, ','), lambda p: trim(p)), '|') AS parts FROM (SELECT insert_seq, min(source_session) AS source_session FROM memories GROUP BY insert_seq)")
def split_lists(spark, d):
    rows = table(spark, d, "memories").groupBy("insert_seq").agg(F.min("source_session").alias("s"))
    return rows.select("insert_seq", F.array_join(scalars.split_list(F.concat(F.coalesce("s", F.lit("")), F.lit(", x ,,"), "insert_seq")), "|").alias("parts"))


@query(f"WITH {M_SQL} SELECT id, CASE WHEN length(coalesce(content, '')) > 0 THEN 1 ELSE 0 END::DOUBLE AS first, CASE WHEN length(coalesce(content, '')) > 0 THEN 1 ELSE 0 END::DOUBLE AS total, 384 AS dim FROM m")
def mock_embeddings(spark, d):
    rows = embed.embed(m(spark, d).select("id", "content"), embed.MockEmbedder(384))
    return rows.select("id", F.col("embedding")[0].cast("double").alias("first"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"), F.size("embedding").alias("dim"))


@query(f"""WITH {M_SQL}, h AS (SELECT id, hex(encode(content)) AS h, length(hex(encode(content))) // 2 AS n FROM m WHERE content <> ''),
  b AS (SELECT id, list_transform(range(16), lambda i: ('0x' || substr(h, (2 * (i % n) + 1)::BIGINT, 2))::INT) AS b FROM h),
  e AS (SELECT id, list_transform(range(16), lambda i: (CASE WHEN b[i + 1] > 127 THEN b[i + 1] - 256 ELSE b[i + 1] END::FLOAT / 255::FLOAT + sin(0.1::DOUBLE * i)::FLOAT)::DOUBLE) AS e FROM b)
SELECT id, round((e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x)))), 5) AS first, round((e[16] / sqrt(list_sum(list_transform(e, lambda x: x * x)))), 5) AS last FROM e""")
def hash_embeddings(spark, d):
    rows = embed.embed(m(spark, d).where("content <> ''").select("id", "content"), embed.HashEmbedder(16))
    return rows.select("id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.round(F.col("embedding")[15].cast("double"), 5).alias("last"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VOCABULARY = {"[PAD]": 0, "[UNK]": 100, "[CLS]": 101, "[SEP]": 102} | {c: 200 + i for i, c in enumerate(_LETTERS)} | {f"##{c}": 300 + i for i, c in enumerate(_LETTERS)}


@query(f"""WITH {M_SQL}, x AS (SELECT id, regexp_extract_all(translate(coalesce(content, ''), '{_LETTERS.upper()}', '{_LETTERS}'), '([[:punct:]]|[^\\s[:punct:]]+)') AS tokens FROM m),
  p AS (SELECT id, flatten(list_transform(tokens, lambda t: CASE WHEN regexp_full_match(t, '[a-z]+') THEN list_transform(range(1, length(t) + 1), lambda i: (CASE WHEN i = 1 THEN 200 ELSE 300 END + ascii(t[i]) - 97)::INT) ELSE [100] END)) AS p FROM x),
  i AS (SELECT id, [101] || p[1:22] || [102] AS i FROM p)
SELECT id, array_to_string(list_resize(i, 24, 0), ',') AS ids, len(i) AS n_tokens FROM i""")
def word_piece_ids(spark, d):
    """Ids and attention mask over a vocabulary of single letters, cut to 24."""
    ids = m(spark, d).select("id", embed.word_piece_ids(F.col("content"), embed.WordPiece(_VOCABULARY, 24)).alias("ids"))
    return ids.select("id", F.array_join("ids", ",").alias("ids"), F.aggregate(embed.attention_mask(F.col("ids")), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_tokens"))


_EDGES = "e AS (SELECT DISTINCT subject, object FROM t), s0 AS (SELECT min(subject) AS s FROM e)"


@query(f"""WITH RECURSIVE {T_SQL}, {_EDGES}, r AS (SELECT s, 1 AS step FROM s0 UNION SELECT object, step + 1 FROM r JOIN e ON e.subject = r.s WHERE step < 40),
  f AS (SELECT s, min(step) AS step FROM r GROUP BY s) SELECT f.step, e.subject, e.object FROM f JOIN e ON e.subject = f.s""")
def kg_chain(spark, d):
    """Steps along all relations from the first subject."""
    rows = t(spark, d).withColumn("predicate", F.lit("next_step"))
    start = rows.agg(F.min("subject").alias("s")).first()["s"] or ""
    return graph.chain(rows, start)


def _split_sql(tf: str) -> str:
    """The search of one word with the number of content terms at hand."""
    sql = "WITH " + _fts_sql(["queue"], "tf0 > 0")
    cut = f", len({_TERMS.format(chr(99) + 'oalesce(content, ' + chr(39) * 2 + ')')}) AS clen FROM m)"
    return sql.replace(" AS terms FROM m)", " AS terms" + cut).replace("len(list_filter(terms, lambda w: w = 'queue'))", tf)


@query(_split_sql("len(list_filter(terms[1:clen], lambda w: w = 'queue'))"))
def fts_search_column(spark, d):
    return _searched(text_index(spark, d).search("content: queue"))


@query(_split_sql("coalesce((clen > 0 AND terms[1] = 'queue')::INT, 0) + coalesce((terms[clen + 1] = 'queue')::INT, 0)"))
def fts_search_initial(spark, d):
    return _searched(text_index(spark, d).search("^queue"))


# -- references -----------------------------------------------------------------------------
for _name, _query in (("p5_found", references.p5_found), ("p5_counts", references.p5_counts), ("p5_validity", references.p5_validity)):
    _QUERIES[_name], _SQL[_name] = _query, references.SQL[_name]


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
