"""Problem 2: items that appear together, with large-basket blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnestra.llm.records import RECORDS_SQL, records
from mnestra.operators.skew import join_unique
from mnestra.sources.tables import reference_key, table

#: Items of a basket from which it is cut into chunks of as many.
CHUNK = 128

#: Frequent items up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ITEMS = 500_000


def frequent_bound(total: int, mentions: int, least: int, share: int) -> int:
    """At most how many items can be frequent, if ``total`` baskets have ``mentions`` items in all."""
    return int(mentions // max(least, total / share, 1))


def frequent_items(baskets: DataFrame, total: int, least: int, share: int) -> DataFrame:
    """``(item, n, no)`` of items in at least ``least`` and at least 1 in ``share`` of all baskets, numbered by name.

    No pair is more frequent than its rarer item, so pairs of others can't reach these bounds.
    """
    n = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return n.where((F.col("n") >= least) & (F.col("n") * share >= total)).withColumn("no", F.row_number().over(W.orderBy("item")))


def together(baskets: DataFrame, total: int, mentions: int, least: int = 5, share: int | None = 2000, chunk: int = CHUNK, broadcast_items: int = BROADCAST_ITEMS) -> DataFrame:
    """``(tag_a, tag_b, n_ab, n_a, n_b, lift, pmi)`` of pairs of items in at least ``least`` and 1 in ``share`` baskets.

    ``baskets`` has ``(record, items)``, ``total`` baskets with at most ``mentions`` items in all; null items are none, repeats count once, baskets under two
    items give no pair, ``tag_a < tag_b``. Lift is how many times more often than chance, pmi its
    binary logarithm. An empty table gives none.

    With ``least`` 1 and no ``share``, all pairs that stand together at all: items are neither counted beforehand nor numbered.

    Otherwise items below the bounds are left out first. If by ``frequent_bound`` at most ``broadcast_items``
    can be left, these are broadcast and the baskets stay where the record's shuffle put them; else
    they are joined by a shuffle that spares hot items. A basket of at most ``chunk`` items gives its pairs in place. A larger one is cut into chunks, and each pair of
    chunks goes to a task of its own choice. Counts are combined before their shuffle.
    """
    spark = baskets.sparkSession
    baskets = baskets.select("record", F.array_distinct(F.filter("items", lambda i: i.isNotNull())).alias("items"))
    every = least <= 1 and share is None
    share = share or max(total, 1)
    few = frequent_bound(total, mentions, least, share) <= broadcast_items
    exploded = baskets.select("record", F.explode("items").alias("item"))
    if every:
        items = exploded.groupBy("item").agg(F.count("*").alias("n")).withColumn("no", F.col("item"))
        kept = baskets.select("record", F.sort_array("items").alias("items"))
    else:
        items = frequent_items(baskets, total, least, share)
        numbered = items.select("item", "no")
        kept = exploded.join(F.broadcast(numbered), "item") if few else join_unique(exploded, numbered, "item")
        kept = kept.groupBy("record").agg(F.sort_array(F.collect_list("no")).alias("items"))
    kept = kept.withColumn("size", F.size("items")).where("size > 1")

    small = kept.where(F.col("size") <= chunk).select("items", F.posexplode("items").alias("at", "a")).select("a", F.explode(F.slice("items", F.col("at") + 2, F.greatest(F.size("items") - F.col("at") - 1, F.lit(0)))).alias("b"))
    starts = F.sequence(F.lit(0), F.floor((F.col("size") - 1) / chunk).cast("int"))
    blocks = kept.where(F.col("size") > chunk).select("record", "items", "size", F.explode(starts).alias("i")).select("*", F.explode(F.sequence("i", F.floor((F.col("size") - 1) / chunk).cast("int"))).alias("j"))
    blocks = blocks.select("record", "i", "j", F.slice("items", F.col("i") * chunk + 1, chunk).alias("left"), F.slice("items", F.col("j") * chunk + 1, chunk).alias("right"))
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "record", "i", "j")
    large = blocks.select(F.explode("left").alias("a"), "right").select("a", F.explode("right").alias("b")).where("a < b")

    n_ab = small.unionByName(large).groupBy("a", "b").agg(F.count("*").alias("n_ab")).where((F.col("n_ab") >= least) & (F.col("n_ab") * share >= total))
    named = lambda s: items.select(F.col("no").alias(s), F.col("item").alias(f"tag_{s}"), F.col("n").alias(f"n_{s}"))
    side = (lambda s: F.broadcast(named(s))) if few else named
    found = n_ab.join(side("a"), "a").join(side("b"), "b")
    lift = F.col("n_ab").cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b"))
    return found.select("tag_a", "tag_b", "n_ab", "n_a", "n_b", F.round(lift, 6).alias("lift"), F.round(F.log2(lift), 6).alias("pmi"), F.lit(total).cast("long").alias("n_total"))


def memory_pairs(spark: SparkSession, sf_dir: str, least: int = 5, share: int | None = 2000) -> DataFrame:
    """Pairs of tags within bounds as in ``together``; the numbers of records and of tags of all rows come from one pass over two columns."""
    memories = table(spark, sf_dir, "memories")
    known = memories.agg(F.countDistinct(reference_key(F.col("id"))).alias("n"), F.sum(F.greatest(F.size("tags"), F.lit(0))).alias("mentions")).first()
    return together(records(memories).withColumnRenamed("terms", "items"), known["n"], known["mentions"] or 0, least, share)


def p2_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of tags that stand together on a record, however rarely."""
    return memory_pairs(spark, sf_dir, 1, None).drop("n_total")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of ``p2_all_pairs`` within the support bounds of ``p2_found``."""
    return memory_pairs(spark, sf_dir).drop("n_total")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at least four times more frequent than chance; products are exact decimals."""
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    return memory_pairs(spark, sf_dir).where(exact("n_ab") * exact("n_total") >= F.lit(4).cast("decimal(1,0)") * exact("n_a") * exact("n_b")).select("tag_a", "tag_b")


_PAIRS_SQL = f"""WITH {RECORDS_SQL},
  has AS (SELECT DISTINCT record, tag FROM spelt),
  single AS (SELECT tag, count(*) AS n FROM has GROUP BY tag),
  pair AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n_ab FROM has x JOIN has y ON x.record = y.record AND x.tag < y.tag GROUP BY ALL)
SELECT tag_a, tag_b, n_ab, a.n AS n_a, b.n AS n_b, total.n AS n_total, n_ab::double * total.n / (a.n::double * b.n) AS rate
FROM pair JOIN single a ON a.tag = tag_a JOIN single b ON b.tag = tag_b, total WHERE n_ab >= 5 AND n_ab * 2000 >= total.n"""

SQL = {
    "p2_pairs": f"SELECT tag_a, tag_b, n_ab, n_a, n_b, round(rate, 6) AS lift, round(log2(rate), 6) AS pmi FROM ({_PAIRS_SQL})",
    "p2_found": f"SELECT tag_a, tag_b FROM ({_PAIRS_SQL}) WHERE n_ab * n_total >= 4 * n_a * n_b",
}
