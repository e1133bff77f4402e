import json
from datetime import datetime

import pytest

from mnestra import providers
from mnestra.cli import main
from mnestra.engine import MemoryEngine, lenient_time
from mnestra.functions.embed import TableEmbedder
from mnestra.sources.config import Config, load


@pytest.fixture
def engine(spark, tmp_path):
    def make(known=None, provider=None, **settings):
        return MemoryEngine(spark, Config(data_dir=str(tmp_path), **settings), provider, TableEmbedder(known or {}, 4))

    return make


def test_life_of_a_record(engine):
    e = engine({"Alice prefers dark mode": [1, 0, 0, 0], "Rust is fast": [0, 1, 0, 0]})
    a = e.store("Alice prefers dark mode", importance=99, tags=["ui"], memory_type="Preference")
    b = e.store("Rust is fast", source_session="s1")
    row = e.get(a).first()
    assert (row["importance"], row["memory_type"], row["tags"]) == (10.0, "preference", ["ui"])
    assert e.stats()["total_memories"] == 2 and e.index_size() == 2
    assert [r["id"] for r in e.search("Alice prefers dark mode").orderBy("rank").collect()][0] == a
    assert [r["id"] for r in e.search_text("rust").collect()] == [b]
    e.update(a, importance=0.0, tags=["x"])
    assert e.get(a).first()["importance"] == 1.0
    with pytest.raises(KeyError):
        e.update("nobody", content="x")
    with pytest.raises(ValueError):
        e.store("again", id=a)
    assert e.apply_decay(0.95) == 2
    assert e.forget(b, "decay") and e.get(b).first()["decay_score"] == pytest.approx(0.12)
    assert e.forget(b, "archive") and e.get(b).first() is None and not e.forget(b, "decay")
    assert e.search_text("rust").count() == 0
    e.add_triples([("Alice", "likes", "dark", a), ("Alice", "likes", "dark", a), ("Bob", "x", "y", "no such memory"), ("C", "d", "e", None)])
    assert e.triples().count() == 2
    assert e.entity_context("dark").count() == 1 and e.query_knowledge(predicate="d").count() == 1
    e.compact()
    assert e.forget(a) and not e.forget(a)
    assert e.triples().count() == 1 and e.memories().count() == 1


def test_batches_are_scored_and_stored_whole(engine, spark, tmp_path):
    e = engine(provider=providers.CannedProvider(lambda task, prompt: "8" if "crucial" in prompt.splitlines()[-1] else "none"))
    rows = spark.createDataFrame([(None, "crucial fact", None, 7), ("x", "odd", None, 7), ("y", "set", 2.0, 7), ("z", None, None, 7)], "id string, content string, importance double, rank int")
    stored = e.store_batch(rows, auto_score=True)
    assert {r["content"]: r["importance"] for r in stored.collect()} == {"crucial fact": 8.0, "odd": 5.0, "set": 2.0, "": 5.0}
    assert {r["id"] for r in stored.collect()} == {r["id"] for r in e.memories().collect()} == {r["id"] for r in e.vectors().collect()}
    with pytest.raises(ValueError):
        e.store_batch(rows)
    assert e.memories().count() == 4 and not list((tmp_path / "projects" / "default" / "staging").iterdir())


def test_recall_follows_the_provider_or_falls_back(engine):
    known = {"q": [1, 0, 0, 0], "near": [1, 0.1, 0, 0], "far": [0, 1, 0, 0]}
    provider = providers.CannedProvider({"rerank": "SELECTED [2] | because\nSELECTED [9] | beyond"})
    e = engine(known, provider)
    assert e.recall("q").count() == 0
    near, far = e.store("near", tags=["a"]), e.store("far", tags=["b"])
    got = e.recall("q").collect()
    assert [(r["id"], r["reasoning"]) for r in got] == [(far, "because")]
    e.provider = providers.MockProvider()
    assert [r["id"] for r in e.recall("q").orderBy("rank").collect()] == [near, far]
    assert [r["id"] for r in e.recall("q", tags=["b"]).collect()] == [far]
    assert e.recall("q", memory_type="decision").count() == 0


def test_consolidation(engine):
    known = {"Alice lives in London": [1, 0, 0, 0], "Alice moved to New York": [0.9, 0.2, 0, 0], "twice": [0, 1, 0, 0], "twice again": [0, 1, 0.01, 0], "log": [0, 0, 1, 0]}
    answer = "TRIPLE | Alice | lives_in | New York\nFACT | fact | 8 | a | Alice moved to New York\nFACT | fact | 3 | b | twice\nTRIPLE | Postgres | uses | Port\nFACT | decision | 6 | b | twice again"
    mock = providers.MockProvider()
    e = engine(known, providers.CannedProvider(lambda task, prompt: answer if task == "extract" else mock.complete(task, prompt)))
    assert e.consolidate("s").new_facts == 0
    london = e.store("Alice lives in London")
    e.store("log", source_session="s")
    e.add_triples([("PostgreSQL", "is_a", "Database", None)])
    report = e.consolidate("s")
    assert [c["existing_memory_id"] for c in report.contradictions] == [london]
    assert e.get(london).first() is None
    assert (report.new_facts, report.updated_facts) == (2, 1)
    rows = {r["content"]: r for r in e.memories().collect()}
    assert rows["twice again"]["importance"] == 6.0 and "twice" not in rows and rows["twice again"]["source_session"] == "s"
    assert {u["subject"] for u in report.knowledge_graph_updates} == {"Alice", "PostgreSQL"}
    assert {r["subject"] for r in e.triples().collect()} == {"PostgreSQL", "Alice"} and e.triples().count() == 2  # the updated fact's triple isn't kept


def test_procedure_chain(engine):
    e = engine({"First, preheat the oven": [1, 0, 0, 0], "Then, mix the batter": [0, 1, 0, 0]}, providers.MockProvider())
    e.store("To bake a cake", source_session="s")
    assert e.consolidate("s").new_facts == 2
    from mnestra.operators.graph import chain

    assert [r["object"] for r in chain(e.triples(), "First, preheat the oven").collect()] == ["Then, mix the batter"]


def test_tools_and_command_line(engine, spark, tmp_path, capsys):
    e = engine(provider=providers.MockProvider())
    id = e.call_tool("mem_store", {"content": "x", "tags": ["a", 3], "importance": "high"})["id"]
    assert e.get(id).first()["importance"] == 5.0
    assert [r["id"] for r in e.call_tool("mem_search", {"query": "x", "limit": "no"})] == [id]
    assert len(e.call_tool("mem_recall", {"query": "x", "since": "garbage", "memory_type": "garbage"})) == 1
    assert e.call_tool("mem_update", {"id": id, "content": "y"}) == {"id": id}
    assert e.call_tool("mem_consolidate", {"session_id": "none"})["new_facts"] == 0
    assert e.call_tool("mem_forget", {"id": id, "mode": "odd"}) == {"forgotten": True}
    with pytest.raises(LookupError):
        e.call_tool("mem_other", {})
    (tmp_path / ".mnestra").mkdir()
    (tmp_path / ".mnestra" / "config.toml").write_text(f'[engine]\ndata_dir = "{tmp_path}"\nembedding_dim = 8\n')
    main(["--directory", str(tmp_path), "--project", "p", "store", "hello", "--tags", "a, b"], spark)
    assert json.loads(main(["--directory", str(tmp_path), "--project", "p", "inspect"], spark))["total_memories"] == 1


def test_config_and_times(tmp_path):
    assert load(directory=str(tmp_path), environ={}).project == "default"
    own = load("mine", str(tmp_path), {"MNESTRA_EMBEDDING_DIM": "64", "MNESTRA_PROJECT": "other", "MNESTRA_LINK_UPDATES": "true"})
    assert (own.project, own.embedding_dim, own.link_updates) == ("mine", 64, True)
    assert own.project_dir.endswith("/projects/mine")
    assert lenient_time("2024-01-01T02:00:00+02:00") == "2024-01-01 00:00:00"
    assert lenient_time("soon") is None and lenient_time(None) is None
    assert datetime.fromisoformat(lenient_time("2024-01-01")) == datetime(2024, 1, 1)


def test_stored_text_survives_consolidation_without_fit_models(spark, tmp_path):
    """Default, stand-in and unknown models: nothing is overwritten, and the caller is told."""
    wrong = [("none", "local", providers.NoModelError), ("mock", "local", providers.NoModelError), ("mock", "mock", providers.NoModelError)]
    for n, (reasoning, embedding, error) in enumerate(wrong):
        e = MemoryEngine(spark, Config(project=str(n), data_dir=str(tmp_path), embedding_dim=8, reasoning_provider=reasoning, embedding_provider=embedding))
        id = e.store("the user's own words", source_session="s1")
        with pytest.raises(error):
            e.consolidate("s1")
        assert [r["content"] for r in e.memories().collect()] == ["the user's own words"] and e.get(id).count() == 1
    for settings in ({"reasoning_provider": "opnai"}, {"embedding_provider": "opnai"}):
        with pytest.raises(providers.UnknownModelError):
            MemoryEngine(spark, Config(data_dir=str(tmp_path), **settings))
    providers.register_provider("Own", lambda model: providers.CannedProvider({"extract": f"FACT | fact | 3 | | by {model}"}))
    e = MemoryEngine(spark, Config(project="own", data_dir=str(tmp_path), embedding_dim=8, reasoning_provider="own", reasoning_model="m", stand_ins=True))
    e.store("to read", source_session="s1")
    report = e.consolidate("s1")
    assert report.new_facts + report.updated_facts == 1 and e.search_text("m").count() == 1


def test_ids_without_regard_to_case_and_outer_blanks(engine):
    known = {"one": [1, 0, 0, 0], "two": [0, 1, 0, 0]}
    e = engine(known)
    assert e.store("one", id="Note-A ") == "note-a"
    with pytest.raises(ValueError):
        e.store("again", id="note-a")
    assert e.get(" NOTE-A").first()["content"] == "one"
    assert [r["id"] for r in e.recall("one").collect()] == ["note-a"] == [r["id"] for r in e.search("one").collect()]
    e.update("Note-A", content="two", importance=7)
    assert (e.get("note-a").first()["importance"], [r["id"] for r in e.recall("two").collect()]) == (7.0, ["note-a"])
    e.add_triples([("a", "b", "c", " NOTE-a"), ("a", "b", "d", "Note-B")])
    assert [r["memory_id"] for r in e.triples().collect()] == ["note-a"]
    assert e.forget("NOTE-A", "decay") and e.forget(" note-A ") and not e.forget("note-a")
    assert e.triples().count() == 0 == e.memories().count()
