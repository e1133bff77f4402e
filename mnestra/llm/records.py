"""Records and their tags: one row for each memories id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnestra.sources.tables import reference_key


def clean_terms(terms: Column) -> Column:
    """Terms without outer blanks and in lower case; null and blank ones are none, repeats stay."""
    return F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))


def records(memories: DataFrame, id_col: str = "id", seq_col: str = "insert_seq", terms_col: str = "tags") -> DataFrame:
    """``(record, terms)``: each id's row of greatest ``seq_col``, with clean terms.

    Ids are compared without outer blanks and regard to case; null and blank ids are no record.
    Rows without a number come before all others; of different rows with one number that with the
    greater terms counts. One shuffle, on the id, after a partial aggregation.
    """
    rows = memories.select(reference_key(F.col(id_col)).alias("record"), F.struct(F.col(seq_col).alias("seq"), F.col(terms_col).alias("terms")).alias("version"))
    return rows.where("record IS NOT NULL").groupBy("record").agg(F.max("version").alias("version")).select("record", clean_terms(F.col("version.terms")).alias("terms"))


def record_count(memories: DataFrame, id_col: str = "id") -> Column:
    """The number of records, as a scalar subquery that reads only the id."""
    return memories.select(reference_key(F.col(id_col)).alias("record")).agg(F.countDistinct("record").alias("n")).scalar()


#: Records a bucket of numbers has on average; a chunk of 65,536 numbers holds one bucket.
BUCKET_RECORDS = 32_768


def numbered_records(memories: DataFrame, id_col: str = "id", seq_col: str = "insert_seq", terms_col: str = "tags", bucket_records: int = BUCKET_RECORDS) -> DataFrame:
    """``(record, number, terms)``: the records of ``records`` with a 64-bit number of their own.

    A record's bucket is its hash modulo the number of buckets, its number the bucket and the record's place among the bucket's, in order
    of name. Numbers depend on the set of records alone, so a task that is run again, or a plan that is run apart, gives the same ones.
    One shuffle, on the bucket, which serves the newest version and the place as well.
    """
    buckets = F.greatest(F.lit(1), F.ceil(record_count(memories, id_col) / F.lit(bucket_records)))
    rows = memories.select(reference_key(F.col(id_col)).alias("record"), F.struct(F.col(seq_col).alias("seq"), F.col(terms_col).alias("terms")).alias("version")).where("record IS NOT NULL")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("record"), buckets)).repartition("bucket")
    newest = rows.groupBy("bucket", "record").agg(F.max("version").alias("version"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("record")) - 1
    return newest.select("record", F.shiftleft("bucket", 24).bitwiseOR(place.cast("long")).alias("number"), clean_terms(F.col("version.terms")).alias("terms"))


#: The same in SQL, for the checks.
RECORDS_SQL = """
  versions AS (SELECT lower(trim(id)) AS record, insert_seq, tags FROM memories WHERE trim(id) <> ''),
  latest AS (SELECT record, tags FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY insert_seq DESC NULLS LAST, tags DESC) AS k FROM versions) WHERE k = 1),
  spelt AS (SELECT record, lower(trim(t)) AS tag FROM (SELECT record, unnest(tags) AS t FROM latest) WHERE trim(t) <> ''),
  total AS (SELECT count(*) AS n FROM latest)"""
