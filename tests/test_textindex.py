"""The stored index gives what a search of the texts gives, whatever the generations it came by."""

import pytest
from pyspark.sql import functions as F
from test_fts import BAD, QUERIES, docs  # noqa: F401

from mnestra.operators import fts
from mnestra.operators.textindex import TextIndex


def found(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):  # noqa: F811
    """Built in three steps: rows as they were, rows changed and removed, one put back."""
    index = TextIndex(spark, str(tmp_path_factory.mktemp("text")))
    old = docs.where("id <> 'd7'").selectExpr("id", "CASE WHEN id IN ('d1', 'd6') THEN 'cache database fox' ELSE content END AS content", "tags", "id = 'd3' AS archived", "insert_seq")
    index.refresh(old.union(spark.createDataFrame([("extra", "database cache", ["db"], False, 99)], old.schema)), source=1)
    index.refresh(docs.where("id IN ('d1', 'd3', 'd4', 'd6', 'd7', 'd8')"), spark.createDataFrame([("extra",), ("nobody",), ("d9",)], "id string"), source=2)
    index.refresh(docs.where("id = 'd9'"), source=3)
    return index


@pytest.mark.parametrize("query", [*QUERIES, "cach*", "qu* brow*", '"quick bro*"', BAD[0]])
def test_like_a_search_of_the_texts(docs, index, query):  # noqa: F811
    assert sorted(found(index.search(query, 100))) == sorted(found(fts.search(docs, query, 100)))


def test_postings_statistics_and_compaction(spark, docs, index):  # noqa: F811
    def counts(df):
        return sorted((r["term"], r["id"], len(r["content_at"]) + len(r["tags_at"]), r["length"]) for r in df.collect())

    want = sorted((r["term"], r["id"], r["tf"], r["length"]) for r in fts.postings(docs).collect())
    assert counts(index.postings()) == want and index.source == 3
    plan = index.postings([("cache", False)])._jdf.queryExecution().toString()
    assert "bucket" in plan and "content " not in plan
    number = index.compact(docs, 4)
    assert index.generations() == [number] and counts(index.postings()) == want and index.source == 4
    index.refresh(docs.limit(0), docs.where("id = 'd1'").select("id"), 5)
    assert sorted(found(index.search("cache", 100))) == sorted(found(fts.search(docs.where("id <> 'd1'"), "cache", 100)))


def test_empty(spark, docs, tmp_path):  # noqa: F811
    index = TextIndex(spark, str(tmp_path / "none"))
    assert index.search("x").count() == 0 and index.source == -1 and index.postings().count() == 0
    index.refresh(docs.limit(0))
    assert index.search("x").count() == 0 and index.search("x", None).count() == 0


def test_buckets_of_words_at_hand(spark):
    words = ["cache", "", "漢字", "x" * 100, "é"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", TextIndex._bucket(F.col("w"), 13).alias("b")).collect()
    assert [r["b"] for r in got] == [TextIndex._bucket_of(r["w"], 13) for r in got]
