"""Records written as plain text and numbers, decoded leniently, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnestra import schema
from mnestra.functions.scalars import parse_memory_type, tags_from_json

_UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def valid_id(id: Column) -> Column:
    """Whether an id is a UUID, with or without hyphens."""
    return F.coalesce(id.rlike(_UUID), F.lit(False))


def parse_time(text: Column) -> Column:
    """The UTC time of a text with date, time and offset (Z or +hh:mm); null for any other."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(shaped, F.to_timestamp_ntz(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def format_time(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def decode(raw: DataFrame) -> DataFrame:
    """Rows of the fixed schema from their text form; rows without a valid id are left out.

    Bad JSON tags are none, an unknown type is a fact, a missing decay score is 1, a missing
    archived flag false. A time that can't be read is null: it isn't taken as now. The session's time zone must be UTC.
    """
    rows = raw.where(valid_id(F.col("id")))
    number = F.monotonically_increasing_id() if "insert_seq" not in raw.columns else F.col("insert_seq").cast("long")
    return rows.select(
        F.lower("id").alias("id"),
        F.col("content").cast("string").alias("content"),
        F.col("importance").cast("double").alias("importance"),
        F.filter(tags_from_json(F.col("tags")), lambda t: t.isNotNull()).alias("tags"),
        parse_memory_type(F.col("memory_type")).alias("memory_type"),
        parse_time(F.col("created_at")).alias("created_at"),
        parse_time(F.col("updated_at")).alias("updated_at"),
        F.coalesce(F.col("decay_score").cast("double"), F.lit(1.0)).alias("decay_score"),
        F.col("source_session").cast("string").alias("source_session"),
        F.col("ttl_days").cast("int").alias("ttl_days"),
        F.coalesce(F.col("archived").cast("boolean"), F.lit(False)).alias("archived"),
        number.alias("insert_seq"),
    ).select(*schema.MEMORIES.names)


def encode(rows: DataFrame) -> DataFrame:
    """The text form of rows: tags as JSON, times with offset, the archived flag as a number."""
    return rows.withColumns({"tags": F.to_json(F.coalesce("tags", F.array().cast("array<string>"))), "created_at": format_time(F.col("created_at")), "updated_at": format_time(F.col("updated_at")), "archived": F.coalesce(F.col("archived").cast("int"), F.lit(0))})
