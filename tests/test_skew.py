from pyspark.sql import functions as F

from mnestra.operators import skew


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 997 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 2000)).alias("k"))
    unique = rows.where("k IS NOT NULL AND k <> 'k7'").select("k").distinct().withColumn("n", F.length("k"))
    assert [r[0] for r in skew.hot_keys(rows, "k").collect()] == ["hot"]
    want = {(r["id"], r["k"], r["n"]) for r in rows.join(unique, "k").collect()}
    got = [(r["id"], r["k"], r["n"]) for r in skew.join_unique(rows, unique, "k").collect()]
    assert set(got) == want and len(got) == len(want)
    assert skew.join_unique(rows.limit(0), unique, "k").count() == 0
