import numpy as np
import pytest
from pyspark.sql import functions as F

from mnestra import schema
from mnestra.operators import vectors


def table(spark, rows):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], d) for i, v, d in rows]
    return spark.createDataFrame(rows, schema.T.StructType([schema.T.StructField(f.name, f.dataType) for f in schema.VECTORS]))


def test_nearest_of_unit_axes(spark):
    live = vectors.live(table(spark, [("x", [1.0, 0, 0, 0], False), ("y", [0.0, 1, 0, 0], False), ("z", [0.0, 0, 1, 0], None)]), 4)
    got = vectors.nearest(live, [("q", [0.9, 0.1, 0, 0])], 2).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [("x", 1), ("y", 2)]
    assert got[0]["similarity"] == pytest.approx(1 / 1.02)


def test_ties_deleted_broken_and_repeated(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2, 3, 4], False) for i in "edcba"] + [("a", [1.0, 2, 3, 4], False), ("D1", [1.0, 2, 3, 4], True), ("s", [1.0], False), ("n", None, False), ("m", [1.0, nan, 0, 0], False), ("i", [inf, 0, 0, 0], False), ("h", [1.0, None, 0, 0], False), (None, [1.0, 2, 3, 4], False)]
    got = vectors.nearest(vectors.live(table(spark, rows), 4), [("q", [1, 2, 3, 4])], 3)
    assert [(r["rank"], r["id"], r["distance"]) for r in got.orderBy("rank").collect()] == [(1, "a", 0.0), (2, "b", 0.0), (3, "c", 0.0)]


def test_repeats_take_no_place(spark):
    rows = [(f"r{i % 3}", [1.0 + i % 3, 0.0], False) for i in range(60)] + [("far", [9.0, 0.0], False), ("two", [5.0, 0.0], False), ("two", [1.5, 0.0], False)]
    got = vectors.nearest(vectors.live(table(spark, rows).coalesce(1), 2), [("q", [1.0, 0.0])], 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["r0", "two", "r1", "r2", "far"]


def test_wrong_length_query_is_refused(spark):
    live = vectors.live(table(spark, [("x", [1.0, 0], False)]), 2)
    with pytest.raises(Exception, match="components"):
        vectors.nearest(live, [("q", [1.0, 0, 0])], 1).collect()


def test_empty(spark):
    assert vectors.nearest(vectors.live(table(spark, []), 4), [("q", [1, 2, 3, 4])], 3).count() == 0
    assert vectors.nearest(vectors.live(table(spark, [("x", [1.0, 0, 0, 0], False)]), 4), [], 3).count() == 0


def test_like_brute_force(spark):
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((300, 8)).astype("f4"), rng.standard_normal((5, 8))
    df = table(spark, [(f"v{i:03}", [float(y) for y in v], False) for i, v in enumerate(x)]).repartition(3)
    live, queries = vectors.live(df, 8), [(str(i), list(v)) for i, v in enumerate(q)]
    for metric in ("l2", "ip"):
        d = 1 - x.astype("f8") @ q.T if metric == "ip" else ((x[:, None].astype("f8") - q[None]) ** 2).sum(2)
        got = {(r["query"], r["rank"]): r["id"] for r in vectors.nearest(live, queries, 7, metric).collect()}
        assert got == {(str(j), k + 1): f"v{i:03}" for j in range(5) for k, i in enumerate(np.argsort(d[:, j], kind="stable")[:7])}
    near = {(r["query"], r["id"]) for r in vectors.within(live, queries, 9.0).collect()}
    d = ((x[:, None].astype("f8") - q[None]) ** 2).sum(2)
    assert near == {(str(j), f"v{i:03}") for i, j in zip(*np.nonzero(d <= 9.0))}
    assert vectors.within(live, queries, 9.0, most=2).groupBy("query").count().agg(F.max("count")).first()[0] <= 2


def test_documents_upsert_remove_normalise(spark):
    df = table(spark, [("a", [0.0, 0], False), ("b", [3.0, 4], False), ("c", [1.0, 0], False)])
    docs = spark.createDataFrame([("a", "D1"), ("b", "D2"), ("c", "D2"), ("a", None)], "id string, document string")
    got = vectors.nearest_documents(vectors.live(df, 2), docs, [("q", [1.0, 0])], 5).orderBy("rank").collect()
    assert [(r["document"], r["distance"]) for r in got] == [("D2", 0.0), ("D1", 1.0)]
    gone = vectors.removed(df, spark.createDataFrame([("b",), ("b",), ("z",)], "id string"))
    assert {r["id"] for r in vectors.live(gone, 2).where(vectors.finite(F.col("embedding"))).collect()} == {"a", "c"}
    back = vectors.upsert(gone, table(spark, [("b", [5.0, 5], False)]))
    assert {r["id"]: list(r["embedding"]) for r in vectors.live(back, 2).collect()}["b"] == [5.0, 5.0]
    unit = df.select("id", vectors.normalised(F.col("embedding")).alias("u"), vectors.distance(F.col("embedding"), F.col("embedding")).alias("d")).orderBy("id").collect()
    assert unit[0]["u"] == [0.0, 0.0] and unit[1]["u"] == [0.6, 0.8] and unit[1]["d"] == 0.0
