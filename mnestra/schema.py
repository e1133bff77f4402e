"""Fixed schemas, enumerations and defaults of the memory model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the model.
MEMORY_TYPES = ("fact", "procedure", "preference", "decision")
FORGET_MODES = ("delete", "archive", "decay")
DEFAULT_IMPORTANCE = 5.0
IMPORTANCE_RANGE = (1.0, 10.0)
RECALL_LIMIT, SEARCH_LIMIT = 8, 20
RECALL_CANDIDATES, SESSION_CAP, ENTITY_CANDIDATES = 50, 1000, 20
CONTRADICTION_CANDIDATES, MERGE_CANDIDATES, MERGE_SIMILARITY = 5, 3, 0.92
DECAY_FLOOR, FORGET_DECAY = 0.01, 0.1

MEMORIES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("memory_type", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("decay_score", T.DoubleType()),
        T.StructField("source_session", T.StringType()),
        T.StructField("ttl_days", T.IntegerType()),
        T.StructField("archived", T.BooleanType()),
        T.StructField("insert_seq", T.LongType()),
    ]
)
VECTORS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("deleted", T.BooleanType())])
TRIPLES = T.StructType(
    [
        T.StructField("triple_id", T.LongType()),
        T.StructField("subject", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("memory_id", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)
SESSIONS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("project", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("ended_at", T.TimestampNTZType()),
        T.StructField("consolidated", T.BooleanType()),
        T.StructField("memory_count", T.IntegerType()),
    ]
)
OPLOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("id", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
