from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnestra import schema
from mnestra.operators import store
from mnestra.sources.versioned import VersionedTable

AT = datetime(2024, 5, 1)


def memory(id, content="x", importance=5.0, tags=("test",), kind="fact", at=AT, decay=1.0, session=None, archived=False, seq=0):
    return (id, content, importance, list(tags) if tags is not None else None, kind, at, at, decay, session, None, archived, seq)


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schema.T.StructType([schema.T.StructField(f.name, f.dataType) for f in schema.MEMORIES]))


def test_current_keeps_the_newest_version(make):
    rows = make(memory("A ", "old", seq=1), memory("a", "new", seq=5, tags=None, kind="Odd"), memory("a", "new", seq=5, tags=None, kind="Odd"), memory(" ", seq=7), memory(None, seq=8), memory("b", archived=None, seq=2, tags=("x", None)))
    got = {r["id"]: r for r in store.current(rows).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["content"], got["a"]["tags"], got["a"]["memory_type"]) == ("new", [], "fact")
    assert (got["b"]["tags"], got["b"]["archived"]) == (["x"], False)


def test_empty_table_and_extra_columns(make):
    empty = make().withColumn("rank", F.lit(1)).withColumn("n", F.lit(2))
    assert store.current(empty).count() == 0
    assert store.stats(store.current(make())).first()[:] == (0, 0.0, {}, 0)
    assert store.list_memories(make()).count() == 0


def test_list_orders_and_filters(make):
    rows = make(memory("a", importance=3.0, seq=1), memory("b", importance=9.0, seq=2, tags=("x", "y")), memory("c", importance=9.0, at=datetime(2025, 1, 1), seq=3, kind="decision"), memory("d", importance=9.0, seq=4, archived=True), memory("e", importance=9.0, seq=0), memory("f", importance=None, seq=9))
    names = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert names(store.list_memories(rows)) == ["c", "e", "b", "a", "f"]
    assert names(store.list_memories(rows, limit=2)) == ["c", "e"]
    assert names(store.list_memories(rows, ["y", "x"])) == ["b"]
    assert names(store.list_memories(rows, memory_type="decision")) == ["c"]
    assert names(store.list_memories(rows, since="2024-06-01 00:00:00")) == ["c"]


def test_stats(make):
    rows = make(memory("a", importance=8.0), memory("b", importance=6.0, kind="procedure"), memory("c", importance=1.0, archived=True))
    assert store.stats(rows).first().asDict() == {"total_memories": 2, "avg_importance": 7.0, "by_type": {"fact": 1, "procedure": 1}, "db_size_bytes": 0}


def test_decay_grows_scores_as_the_formula_says(make):
    rows = make(memory("a", importance=5.0), memory("b", importance=10.0), memory("c", decay=0.01), memory("d", archived=True), memory("e", decay=None))
    got = {r["id"]: (r["decayed"], r["decay_score"]) for r in store.apply_decay(rows, 0.95).collect()}
    assert got["a"][1] == pytest.approx(1.20) and got["b"][1] == pytest.approx(1.45)
    assert got["c"] == (False, 0.01) and got["d"] == (False, 1.0) and got["e"] == (False, None)


def test_forget_by_decay(make, spark):
    rows = make(memory("a"), memory("b"), memory("c", archived=True))
    got = {r["id"]: r["decay_score"] for r in store.forget_by_decay(rows, spark.createDataFrame([("a",), ("a",), ("c",)], "id string")).collect()}
    assert got == {"a": pytest.approx(0.1), "b": 1.0, "c": 1.0}


def test_insert_rejects_taken_ids(make):
    stored, rejected = store.insert_records(make(memory("a")), make(memory("a", seq=5), memory("b", "one", seq=6), memory("b", "two", seq=7)))
    assert [(r["id"], r["content"]) for r in stored.collect()] == [("b", "one")]
    assert sorted(r["id"] for r in rejected.collect()) == ["a", "b"]


def test_partial_update(make, spark):
    changes = spark.createDataFrame([("a", "new", None, None, datetime(2025, 1, 1)), ("a", None, 99.0, ["t"], datetime(2025, 1, 2)), ("b", "no", None, None, AT)], "id string, content string, importance double, tags array<string>, at timestamp_ntz")
    got = {r["id"]: r for r in store.update_records(make(memory("a"), memory("b", archived=True), memory("c")), changes).collect()}
    assert (got["a"]["content"], got["a"]["importance"], got["a"]["tags"], got["a"]["updated_at"]) == ("new", 10.0, ["t"], datetime(2025, 1, 2))
    assert got["b"]["content"] == "x" and got["c"]["updated_at"] == AT


def test_session_rows_are_cut_by_the_global_cap(make):
    rows = make(memory("a", importance=9.0, session="s", seq=1), memory("b", importance=8.0, seq=2), memory("c", importance=7.0, session="s", seq=3))
    assert [r["id"] for r in store.session_rows(rows, "s", cap=2).collect()] == ["a"]


def test_fold(spark):
    ops = [(1, "A", "insert", 7.0), (2, "a ", "update", None), (3, "a", "decay", 0.5), (3, "a", "decay", 0.5), (4, "a", "decay", 7.0), (5, "a", "archive", None), (1, "b", "insert", 3.0), (2, "b", "delete", None), (3, "b", "update", 9.0), (4, "c", "update", 1.0), (1, "d", "insert", 1.0), (2, "d", "delete", None), (3, "d", "insert", 99.0), (9, None, "insert", 1.0)]
    log = spark.createDataFrame([(s, datetime(2024, 1, 1, s), i, o, v) for s, i, o, v in ops], schema.OPLOG)
    got = {r["id"]: r for r in store.fold_oplog(log).collect()}
    assert set(got) == {"a", "d"}
    assert (got["a"]["importance"], got["a"]["decay_score"], got["a"]["archived"], got["a"]["updated_at"]) == (7.0, 0.5, True, datetime(2024, 1, 1, 5))
    assert (got["d"]["importance"], got["d"]["inserted_seq"]) == (10.0, 3)


def test_max_merge(make, spark):
    facts = spark.createDataFrame([("a", "f1", 3.0), ("a", "f2", 6.0), ("z", "f", 9.0)], "id string, content string, importance double")
    assert [r[:] for r in store.max_merge(make(memory("a"), memory("b")), facts).collect()] == [("a", "f2", 6.0)]


def test_a_write_under_way_survives_compaction(spark, tmp_path):
    """It began before the compaction and ends after it: its rows count by the time it began."""
    table = VersionedTable(spark, str(tmp_path / "t"), T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.LongType())]), ["id"])
    rows = lambda *r: spark.createDataFrame(list(r), "id string, x long")
    first = table.upsert(rows(("a", 1), ("b", 1), ("d", 1)))
    table.delete(rows(("d", 0)))
    late = first + 1  # numbered between both writes, not finished yet
    table.upsert(rows(("b", 3)))
    table.compact()
    rows(("a", 2), ("b", 2), ("c", 2), ("d", 2)).withColumn("_gone", F.lit(False)).write.parquet(f"{table.path}/v={late}")
    want = {("a", 2), ("b", 3), ("c", 2)}
    assert {tuple(r) for r in table.read().collect()} == want
    table.compact()
    assert {tuple(r) for r in table.read().collect()} == want and len(table.versions()) == 1
    assert {tuple(r) for r in table.read(rows(("b", 0), ("z", 0))).collect()} == {("b", 3)}
    changed, removed, version = table.changes(late)
    assert version == table.versions()[-1] and {r["id"] for r in removed.collect()} == {"d"} and changed.count() == 3
