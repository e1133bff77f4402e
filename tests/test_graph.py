from datetime import datetime, timedelta

import pytest

from mnestra import schema
from mnestra.operators import graph

AT = datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(i, s, p, o, m, AT + timedelta(days=d)) for i, s, p, o, m, d in rows], schema.TRIPLES)


def ids(df):
    return sorted(r["triple_id"] for r in df.collect())


ROWS = [(1, "Alice", "lives_in", "Berlin", "m1", 5), (2, "Alice", "lives_in", "Berlin", "m2", 6), (3, "Bob", "knows", "Alice", " M3 ", 1), (4, "Berlin", "in", "Germany", None, 2), (4, "Berlin", "in", "Germany", None, 2), (5, "Bob", "likes", None, "", 3)]


def test_match_and_insert_ignore(spark):
    t = graph.triples(table(spark, ROWS))
    assert ids(t) == [1, 2, 3, 4, 5]
    assert ids(graph.unique_triples(t)) == [1, 3, 4, 5]
    assert ids(graph.match(t)) == [1, 2, 3, 4, 5]
    assert ids(graph.match(t, "Alice", "lives_in")) == [1, 2]
    assert ids(graph.match(t, object="Alice")) == [3]
    assert ids(graph.about(t, "Berlin")) == [1, 2, 4]


def test_provenance(spark):
    t = graph.triples(table(spark, ROWS))
    known = spark.createDataFrame([("m1", True), ("m3", False)], "id string, archived boolean")
    assert ids(graph.with_known_memory(t, known)) == [1, 3, 4, 5]
    assert ids(graph.without_memories(t, spark.createDataFrame([("m3",), ("m1",), (None,)], "id string"))) == [2, 4, 5]


def test_recent_entities(spark):
    got = graph.recent_entities(graph.triples(table(spark, ROWS)), 10).orderBy("rank").collect()
    # Alice counts as the subject of triple 1, Berlin as the subject of 4, Bob of 3
    assert [r["name"] for r in got] == ["Alice", "Berlin", "Germany", "Bob"]
    assert graph.recent_entities(table(spark, []), 10).count() == 0


def test_chain(spark):
    t = table(spark, [(1, "a", "next_step", "b", None, 0), (2, "b", "next_step", "c", None, 0), (3, "c", "next_step", "a", None, 0), (4, "b", "other", "z", None, 0)])
    got = graph.chain(t, "a", most=5).orderBy("step").collect()
    assert [(r["step"], r["subject"], r["object"]) for r in got] == [(1, "a", "b"), (2, "b", "c"), (3, "c", "a")]


def test_chain_has_no_step_limit(spark):
    n = 70
    t = table(spark, [(i, f"s{i}", "next_step", f"s{i + 1}", None, 0) for i in range(n)] + [(n, "s1", "next_step", "s5", None, 0), (n + 1, "s9", "next_step", None, None, 0)]).coalesce(1).cache()
    got = {(r["subject"], r["object"]): r["step"] for r in graph.chain(t, "s0").collect()}
    assert len(got) == n + 2 and got["s69", "s70"] == 67 and got["s4", "s5"] == 5 and got["s5", "s6"] == 3
    with pytest.raises(ValueError, match="more than 3 steps"):
        graph.chain(t, "s0", most=3)
    assert graph.chain(t, "nowhere").count() == 0
