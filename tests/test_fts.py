"""The text index against SQLite's own."""

import sqlite3

import pytest

from mnestra.operators import fts

DOCS = [
    ("PostgreSQL database on RDS", "db,cloud", 0),
    ("Redis cache for sessions; cache cache", "cache", 0),
    ("Le café du coin, naïve façade", "fr", 0),
    ("a-b c_d e.f +g database cache", "", 0),
    ("archived database row", "db", 1),
    ("", "empty content", 0),
    ("the quick brown fox jumps over the lazy dog", "fox", 0),
    ("brown quick fox", "db fox", 0),
    ("quickly browning foxes", "", 0),
    ("数据库 漢字 cache", "zh", 0),
    *[(f"filler number {i} with words", "f", 0) for i in range(12)],
]
QUERIES = ["database", "cache", "database cache", "database OR cache", "cache NOT database", '"quick brown"', "quick*", "content:fox", "tags:fox", "cafe", "CAFÉ", "(database OR fox) AND cache", "quick AND fox OR redis", "^brown", "brown + quick", '"brown quick" OR tags:db', "words", "missing", "content:(quick fox)", "NEAR(quick fox)", "NEAR(quick fox, 1)", "NEAR(fox quick, 0)", 'NEAR("quick brown" dog, 3) OR redis', "tags: NEAR(db fox, 2)", "NEAR(cache cache, 2)", "NEAR(the the fox, 9) AND dog"]
BAD = ["what database are we using?", "a-b", "don't", "", '"open', "AND x", "x AND", "nosuch:term", "(a", "a)", "(a OR b) c", "a (b OR c)", "NEAR(a b", "NEAR(a b, x)", "x OR", "()", "a OR AND b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i}", c, t.split(",") if t else [], bool(a), i) for i, (c, t, a) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "id string, content string, tags array<string>, archived boolean, insert_seq long").cache()


@pytest.fixture(scope="module")
def lite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, tags)")
    con.executemany("INSERT INTO f(rowid, content, tags) VALUES (?, ?, ?)", [(i, c, " ".join(t.split(","))) for i, (c, t, _) in enumerate(DOCS)])
    return con


@pytest.mark.parametrize("query", QUERIES)
def test_rows_and_scores(docs, lite, query):
    want = [(f"d{i}", s) for i, s in lite.execute("SELECT rowid, rank FROM f WHERE f MATCH ? ORDER BY rank, rowid", (query,)) if not DOCS[i][2]]
    got = [(r["id"], r["score"]) for r in fts.search(docs, query, 100, digits=9).orderBy("rank").collect()]
    assert dict(got).keys() == dict(want).keys()
    for id, score in want:
        assert dict(got)[id] == pytest.approx(score, abs=1e-8)


@pytest.mark.parametrize("query", BAD)
def test_syntax_errors_match_nothing(docs, lite, query):
    with pytest.raises(sqlite3.OperationalError):
        lite.execute("SELECT rowid FROM f WHERE f MATCH ?", (query,)).fetchall()
    assert fts.search(docs, query).count() == 0


def test_limit_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", "x y", None, False, 2), ("b", "x y", None, False, 1), ("c", None, None, False, 3), ("d", "z", ["x"], False, 4), ("e", "w", [], False, 5), ("f", "w", [], False, 6)], "id string, content string, tags array<string>, archived boolean, insert_seq long")
    got = [(r["rank"], r["id"]) for r in fts.search(rows, "y", 1).collect()]
    assert got == [(1, "b")]
    assert fts.search(rows.limit(0), "x").count() == 0


def test_postings_and_statistics(docs):
    assert {(r["id"], r["tf"]) for r in fts.postings(docs).where("term = 'cache'").collect()} == {("d1", 4), ("d3", 1), ("d9", 1)}
    assert fts.term_statistics(docs).where("term = 'cache'").first()[1:] == (3, 6)
