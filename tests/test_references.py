from datetime import datetime

from pyspark.sql import functions as F

from mnestra.operators import references

REF = "src_table string, row_key long, parent string, key string, ref_time timestamp_ntz"
DEL = "parent string, key string, seq long, at timestamp_ntz"
PAR = "parent string, key string, valid_from timestamp_ntz"


def run(spark, refs, parents, deletes):
    got = references.orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), spark.createDataFrame([(*d, n, day(n + 1)) for n, d in enumerate(deletes)], DEL))
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])


def day(n):
    return datetime(2024, 1, n)


def test_reasons(spark):
    refs = [("t", 1, "p", "a", day(5)), ("t", 2, "p", "a", day(1)), ("t", 3, "p", "gone", day(5)), ("t", 4, "p", "none", day(5)), ("t", 4, "p", "none", day(5)), ("t", 5, "p", None, day(5)), ("t", 6, "q", "a", day(5)), ("t", 7, "p", "a", None), ("t", 8, "p", "open", day(1)), ("t", 9, "p", "back", day(5)), ("t", 10, "p", "none", None)]
    parents = [("p", "a", day(3)), ("p", "a", day(4)), ("p", "open", None), ("p", "back", day(2)), ("p", None, day(1))]
    deletes = [("p", "gone"), ("p", "gone"), ("p", "back"), ("p", None)]
    assert run(spark, refs, parents, deletes) == [("t", 2, "late", "2024-01"), ("t", 3, "deleted", "2024-01"), ("t", 4, "missing", "2024-01"), ("t", 6, "missing", "2024-01"), ("t", 10, "missing", None)]


def test_empty(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [("t", 1, "p", "a", day(1))], [], []) == [("t", 1, "missing", "2024-01")]


def test_hot_key_is_dealt_out_and_whole(spark):
    refs = spark.range(3000).select(F.lit("t").alias("src_table"), F.col("id").alias("row_key"), F.lit("p").alias("parent"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), F.lit(day(5)).cast("timestamp_ntz").alias("ref_time"))
    parents = spark.createDataFrame([("p", "hot", day(9))], PAR)
    got = references.orphan_references(refs, parents, spark.createDataFrame([], DEL))
    assert {r["reason"]: r["count"] for r in got.groupBy("reason").count().collect()} == {"late": 1000, "missing": 2000}


def test_intervals(spark):
    parents = spark.createDataFrame([("p", "a", day(4)), ("p", "a", day(3)), ("p", "back", day(2))], PAR)
    deletes = spark.createDataFrame([("p", "gone", 7, day(9)), ("p", "gone", 8, day(6)), ("p", "back", 1, day(1)), ("p", "untimed", 2, None), ("p", None, 3, day(1))], DEL)
    got = {r["key"]: (r["valid_from"], r["valid_to"], r["ended"]) for r in references.validity(parents, deletes).collect()}
    assert got == {"a": (day(3), None, False), "back": (day(2), None, False), "gone": (None, day(6), True), "untimed": (None, None, True)}
