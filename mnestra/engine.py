"""The engine: a project's store, vectors and triples with everything that works on them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra import providers, schema
from mnestra.functions import scalars
from mnestra.functions.embed import Embedder, embed
from mnestra.operators import graph, store, vectors
from mnestra.operators.textindex import TextIndex
from mnestra.plans import consolidate, retrieve
from mnestra.sources.config import Config
from mnestra.sources.ship import ship_package
from mnestra.sources.tables import reference_key
from mnestra.sources.versioned import VersionedTable


@dataclass
class ConsolidationReport:
    session_id: str
    new_facts: int = 0
    updated_facts: int = 0
    contradictions: list[dict] = field(default_factory=list)
    knowledge_graph_updates: list[dict] = field(default_factory=list)


class MemoryEngine:
    """Reads are DataFrames; writes append versions. Rows, vectors and triples are written by the same call.

    Ids are compared, and written, without outer blanks and in lower case.
    """

    def __init__(self, spark: SparkSession, config: Config = Config(), provider: providers.Provider | None = None, embedder: Embedder | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None), new_id: Callable[[], str] = lambda: str(uuid.uuid4())):
        self.spark, self.config, self.now, self.new_id = spark, config, now, new_id
        ship_package(spark)
        self.provider = provider or providers.provider(config.reasoning_provider, config.reasoning_model)
        self.embedder = embedder or providers.embedder(config.embedding_provider, config.embedding_dim, config.embedding_model)
        root = config.project_dir
        self._memories = VersionedTable(spark, f"{root}/memories", schema.MEMORIES, ["id"])
        self._vectors = VersionedTable(spark, f"{root}/vectors", schema.VECTORS, ["id"])
        self._triples = VersionedTable(spark, f"{root}/triples", schema.TRIPLES, ["triple_id"])
        self._text = TextIndex(spark, f"{root}/text")

    @property
    def _bare(self) -> bool:
        """Whether there is no language model."""
        return isinstance(self.provider, providers.NoProvider)

    # -- tables ---------------------------------------------------------------------------
    def memories(self) -> DataFrame:
        return self._memories.read()

    def vectors(self) -> DataFrame:
        return self._vectors.read()

    def triples(self) -> DataFrame:
        return self._triples.read()

    def live_vectors(self) -> DataFrame:
        return vectors.live(self.vectors(), self.embedder.dim)

    def index_size(self) -> int:
        """Vectors of the index, those marked as deleted too."""
        return vectors.index_size(self.vectors()).first()["n_vectors"]

    def compact(self) -> None:
        for t in (self._vectors, self._triples):
            t.compact()
        version = self._memories.compact()
        self._text.compact(self.memories(), version)

    def text_index(self) -> TextIndex:
        """The text index, brought up to the newest version of the rows: only what was written since is read."""
        changed, removed, version = self._memories.changes(known := self._text.source)
        if version > known:
            self._text.refresh(changed, removed, version)
        return self._text

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder.embed_batch([text])[0]]

    # -- writes ---------------------------------------------------------------------------
    def store_batch(self, rows: DataFrame, auto_score: bool = False) -> DataFrame:
        """Store rows with at least ``content``; defaults fill the rest. Returns the stored rows.

        A null or blank id gets a new one; an id that is taken or met before in the batch is an error.
        ``auto_score`` rates rows without an importance by the provider, on the executors; without a provider they get the default.
        """
        have, now, provider = set(rows.columns), self.now(), self.provider
        col = lambda n, kind, default=None: (F.col(n) if n in have else F.lit(None)).cast(kind) if default is None else F.coalesce((F.col(n) if n in have else F.lit(None)).cast(kind), default)
        shaped = rows.select(
            F.coalesce(reference_key(col("id", "string")), F.uuid()).alias("id"),
            col("content", "string", F.lit("")).alias("content"),
            scalars.clamp(col("importance", "double")).alias("importance"),
            F.coalesce(col("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
            scalars.parse_memory_type(col("memory_type", "string")).alias("memory_type"),
            col("created_at", "timestamp_ntz", F.lit(now)).alias("created_at"),
            F.lit(now).cast("timestamp_ntz").alias("updated_at"),
            F.lit(1.0).alias("decay_score"),
            col("source_session", "string").alias("source_session"),
            col("ttl_days", "int").alias("ttl_days"),
            F.lit(False).alias("archived"),
            F.monotonically_increasing_id().alias("insert_seq"),
        )
        if auto_score and not self._bare:
            shaped = shaped.withColumn("importance", F.coalesce("importance", scalars.parse_score(providers.answers(provider, "score", providers.score_prompt, F.when(F.col("importance").isNull(), F.col("content"))))))
        shaped = shaped.withColumn("importance", F.coalesce("importance", F.lit(schema.DEFAULT_IMPORTANCE)))
        # ids are random: the batch is written before it is judged, so that all later reads agree
        staged = VersionedTable(self.spark, f"{self.config.project_dir}/staging/{self.new_id()}", schema.MEMORIES, ["insert_seq"])
        staged.upsert(shaped)
        batch = staged.read()
        old = self.memories()
        stored, rejected = store.insert_records(old, batch)
        if clash := rejected.first():
            staged.drop()
            raise ValueError(f"id {clash['id']} is taken")
        base = (old.agg(F.max("insert_seq").alias("n")).first()["n"] or 0) + 1
        stored = self._memories.written(self._memories.upsert(stored.withColumn("insert_seq", F.col("insert_seq") + base)))
        staged.drop()
        self._vectors.upsert(embed(stored.select("id", "content"), self.embedder).select("id", "embedding", F.lit(False).alias("deleted")))
        return stored

    def store(self, content: str, auto_score: bool = False, **fields: object) -> str:
        """Store one record and return its id, as it is kept."""
        id = str(fields.pop("id", None) or self.new_id())
        if fields.get("importance") is not None:
            fields["importance"] = float(fields["importance"])
        names = [f for f in schema.MEMORIES if f.name in fields]
        rows = self.spark.createDataFrame([(id, content, *[fields[f.name] for f in names])], schema.T.StructType([schema.MEMORIES["id"], schema.MEMORIES["content"], *[schema.T.StructField(f.name, f.dataType) for f in names]]))
        return self.store_batch(rows, auto_score).first()["id"]

    def get(self, id: str) -> DataFrame:
        return store.get(self.memories(), id)

    def update(self, id: str, content: str | None = None, importance: float | None = None, tags: Sequence[str] | None = None) -> None:
        """Change given fields of a visible record, and its vector with its content. An unknown id is an error."""
        old = self.get(id)
        found = old.first()
        if found is None:
            raise KeyError(id)
        change = self.spark.createDataFrame([(found["id"], content, float(importance) if importance is not None else None, list(tags) if tags is not None else None, self.now())], "id string, content string, importance double, tags array<string>, at timestamp_ntz")
        self._memories.upsert(store.update_records(old, change))
        if content is not None:
            self._put_vectors([(found["id"], self._vector(content))])

    def _put_vectors(self, rows: list[tuple[str, list[float]]]) -> None:
        for id, v in rows:
            if len(v) != self.embedder.dim:
                raise ValueError(f"vector of {id} has {len(v)} components, not {self.embedder.dim}")
        self._vectors.upsert(self.spark.createDataFrame([(i, v, False) for i, v in rows], schema.VECTORS))

    def forget(self, id: str, mode: str = "delete") -> bool:
        """Delete, archive or decay a record; whether there was one. An unknown mode deletes."""
        key = reference_key(F.lit(id))
        rows = self.memories().where(F.col("id") == key)
        if mode == "archive":
            return self._archive([id]) > 0
        if mode == "decay":
            seen = store.visible(rows)
            if seen.first() is None:
                return False
            self._memories.upsert(store.forget_by_decay(seen, seen.select("id")))
            return True
        existed = rows.first() is not None
        if not existed:
            return False
        ids = rows.select("id")
        vector = self.vectors().where(F.col("id") == key)
        if vector.first() is not None:
            self._vectors.upsert(vectors.removed(vector, ids))
        linked = self.triples()
        kept = graph.without_memories(linked, ids).select("triple_id")
        self._triples.delete(linked.join(kept, "triple_id", "left_anti"))
        self._memories.delete(ids)
        return True

    def _archive(self, ids: Sequence[str]) -> int:
        rows = self.memories().where(F.col("id").isin(*(reference_key(F.lit(i)) for i in ids))) if ids else self.memories().limit(0)
        n = rows.count()
        if n:
            self._memories.upsert(rows.withColumn("archived", F.lit(True)).withColumn("updated_at", F.lit(self.now()).cast("timestamp_ntz")))
        return n

    def apply_decay(self, factor: float) -> int:
        """Decay all visible rows above the floor; how many."""
        due = store.apply_decay(self.memories(), factor).where("decayed").drop("decayed")
        n = due.count()
        self._memories.upsert(due)
        return n

    def add_triples(self, rows: Sequence[tuple[str, str, str, str | None]]) -> DataFrame:
        """Insert (subject, predicate, object, memory_id); known ones are ignored, those of unknown memories rejected."""
        old = self.triples()
        base = (old.agg(F.max("triple_id").alias("n")).first()["n"] or 0) + 1
        new = self.spark.createDataFrame([(base + i, *r, self.now()) for i, r in enumerate(rows)], schema.TRIPLES).withColumn("memory_id", reference_key(F.col("memory_id")))
        good = graph.with_known_memory(new, self.memories())
        kept = graph.unique_triples(old.unionByName(good)).where(F.col("triple_id") >= base)
        self._triples.upsert(kept)
        return kept

    # -- reads ----------------------------------------------------------------------------
    def list(self, tags: Sequence[str] = (), memory_type: str | None = None, since: str | None = None, limit: int = 100) -> DataFrame:
        return store.list_memories(self.memories(), tags, memory_type, since, limit)

    def stats(self) -> dict:
        row = store.stats(self.memories()).first()
        return {"total_memories": row["total_memories"], "avg_importance": row["avg_importance"], "by_type": row["by_type"], "db_size_bytes": row["db_size_bytes"]}

    def search_text(self, query: str, limit: int = schema.SEARCH_LIMIT) -> DataFrame:
        return self.text_index().search(query, limit)

    def search(self, query: str, limit: int = schema.SEARCH_LIMIT, tags: Sequence[str] = ()) -> DataFrame:
        return retrieve.hybrid_search(self.memories(), self.live_vectors(), query, self._vector(query), limit, tags, self.text_index())

    def recall(self, query: str, limit: int = schema.RECALL_LIMIT, tags: Sequence[str] = (), since: str | None = None, memory_type: str | None = None) -> DataFrame:
        """Vector candidates, filtered, then put in order by the provider; in similarity order if it selects none or there is none."""
        candidates = retrieve.recall_candidates(self.memories(), self.live_vectors(), self._vector(query), tags, since, memory_type)
        listed = retrieve.candidate_text(candidates).first()["text"]
        answer = self.provider.complete("rerank", providers.rerank_prompt(query, listed, limit)) if listed and not self._bare else ""
        return retrieve.selected(candidates, self.spark.createDataFrame([("answer", answer)], "response_id string, response string"), limit)

    def entity_context(self, entity: str) -> DataFrame:
        return graph.about(self.triples(), entity)

    def query_knowledge(self, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:
        return graph.match(self.triples(), subject, predicate, object)

    def recent_entities(self, limit: int = schema.ENTITY_CANDIDATES) -> DataFrame:
        return graph.recent_entities(self.triples(), limit)

    # -- consolidation --------------------------------------------------------------------
    def resolve_entities(self, rows: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
        """Subjects and objects under the names the store knows. A known subject stays; each call sees stored triples only."""
        known_triples = self.triples()
        names = sorted({x for s, _, o in rows for x in (s, o)})
        asked = self.spark.createDataFrame([(n,) for n in names], "name string")
        known = {r["name"] for r in graph.known_entities(known_triples.where(F.col("subject").isin(*names)), asked).where("known").collect()} if names else set()
        recent = [r["name"] for r in graph.recent_entities(known_triples, schema.ENTITY_CANDIDATES).orderBy("rank").collect()]

        def resolve(name: str) -> str:
            if name in known or not recent:
                return name
            return self.provider.complete("resolve", providers.resolve_prompt(name, recent)).strip().strip('"')

        return [(resolve(s), p, resolve(o)) for s, p, o in rows]

    def detect_contradictions(self, facts: Sequence[tuple[str, str, Sequence[float]]]) -> list[dict]:
        """What the provider finds among each fact's nearest rows; ``facts`` are (name, content, vector)."""
        if not facts:
            return []
        found = consolidate.contradiction_candidates(self.memories(), self.live_vectors(), facts).orderBy("fact", "ordinal").collect()
        out = []
        for name, content, _ in facts:
            near = [r for r in found if r["fact"] == name]
            if not near:
                continue
            answer = self.provider.complete("contradict", providers.contradict_prompt(content, [r["content"] or "" for r in near]))
            parsed = scalars.parse_contradictions(self.spark.createDataFrame([(name, answer)], "response_id string, response string")).orderBy("pos").collect()
            out += [
                {"existing_memory_id": near[p["ordinal"] - 1]["id"], "new_content": content, "existing_content": near[p["ordinal"] - 1]["content"], "explanation": p["explanation"]}
                for p in parsed
                if p["ordinal"] is not None and 1 <= p["ordinal"] <= len(near)
            ]
        return out

    def consolidate(self, session_id: str) -> ConsolidationReport:
        """Facts of a session: extracted, resolved, checked against what is stored, then merged into it in order.

        Later facts see what earlier ones wrote; the contradiction check sees the state before all. A
        triple of a fact that became an update is reported, and stored only with ``link_updates``.

        Merging replaces stored text by what is near to it, so it needs a language model and an embedder that tells texts apart; a
        stand-in for either has to be named, the embedder's by ``stand_ins``, else nothing is touched and an error is raised.
        """
        if self._bare:
            raise providers.NoModelError("consolidation needs a language model, and reasoning_provider is none")
        if not (self.embedder.distinct or self.config.stand_ins):
            raise providers.NoModelError("the embedder doesn't tell texts apart, so merging by similarity would overwrite what has nothing to do with a fact")
        report = ConsolidationReport(session_id)
        text = consolidate.session_text(self.memories(), session_id).first()["text"]
        if not text:
            return report
        answer = self.provider.complete("extract", providers.extract_prompt(text))
        facts = scalars.parse_facts(self.spark.createDataFrame([("answer", answer)], "response_id string, response string")).orderBy("pos").collect()
        with_triple = [f for f in facts if f["subject"] is not None]
        resolved = dict(zip([f["pos"] for f in with_triple], self.resolve_entities([(f["subject"], f["predicate"], f["object"]) for f in with_triple])))
        embedded = [[float(x) for x in v] for v in self.embedder.embed_batch([f["content"] for f in facts])] if facts else []
        report.contradictions = self.detect_contradictions([(str(f["pos"]), f["content"], v) for f, v in zip(facts, embedded)])
        self._archive([c["existing_memory_id"] for c in report.contradictions])

        inserts, updates, links = self._merge(facts, embedded, session_id)
        report.new_facts, report.updated_facts = sum(new for _, new in links.values()), sum(not new for _, new in links.values())
        if inserts or updates:
            self._memories.upsert(self.spark.createDataFrame([*updates.values(), *inserts.values()], self._memories.schema))
            self._put_vectors([(id, v) for id, v in self._overlay.items()])
        if resolved:
            rows = [(*resolved[p], links[p][0] if links[p][1] or self.config.link_updates else self.new_id()) for p in resolved]
            self.add_triples(rows)
            report.knowledge_graph_updates = [dict(zip(("subject", "predicate", "object"), r[:3])) for r in rows]
        return report

    def _merge(self, facts: list, embedded: list[list[float]], session_id: str) -> tuple[dict, dict, dict]:
        """Each fact in order: into what is stored or was written before it, else as a new row. A session's facts are few."""
        inserts: dict[str, tuple] = {}
        updates: dict[str, tuple] = {}
        links: dict[int, tuple[str, bool]] = {}
        self._overlay: dict[str, list[float]] = {}
        if not facts:
            return inserts, updates, links
        memories = self.memories()
        targets = consolidate.merge_candidates(memories, self.live_vectors(), [(str(f["pos"]), v) for f, v in zip(facts, embedded)], schema.MERGE_CANDIDATES + len(facts)).orderBy("fact", "rank").collect()
        names = sorted({t["id"] for t in targets})
        shown = {r["id"]: r for r in store.visible(memories).where(F.col("id").isin(*names)).collect()} if names else {}
        seq = (memories.agg(F.max("insert_seq").alias("n")).first()["n"] or 0) + 1
        fields = schema.MEMORIES.names
        for f, v in zip(facts, embedded):
            stored = [(t["similarity"], t["id"], t["visible"]) for t in targets if t["fact"] == str(f["pos"]) and t["id"] not in self._overlay]
            written = [(1 / (1 + round(float(((np.array(x) - np.array(v)) ** 2).sum()), 9)), id, True) for id, x in self._overlay.items()]
            target = consolidate.first_target([*stored, *written], self.config.merge_similarity)
            now = self.now()
            if target is None:
                id = self.new_id()
                inserts[id] = (id, f["content"], f["importance"], list(f["tags"]), f["memory_type"], now, now, 1.0, session_id, None, False, seq + len(inserts))
                links[f["pos"]] = (id, True)
            else:
                id, pool = target, inserts if target in inserts else updates
                old = dict(zip(fields, pool[target] if target in pool else [shown[target][c] for c in fields]))
                old |= {"content": f["content"], "importance": max(old["importance"] or 0.0, f["importance"]), "updated_at": now}
                pool[target] = tuple(old[c] for c in fields)
                links[f["pos"]] = (id, False)
            self._overlay[id] = v
        return inserts, updates, links

    # -- tools ----------------------------------------------------------------------------
    def call_tool(self, name: str, arguments: dict) -> object:
        """The six operations by name, with lenient arguments: a value of a wrong type counts as absent."""
        get = lambda k, kind, default=None: arguments[k] if isinstance(arguments.get(k), kind) and not isinstance(arguments.get(k), bool) else default
        tags = [t for t in get("tags", list, get("filter_tags", list, [])) if isinstance(t, str)]
        rows = lambda df: [r.asDict() for r in df.orderBy("rank").collect()]
        if name == "mem_store":
            kind = get("memory_type", str)
            return {"id": self.store(get("content", str, ""), auto_score="importance" not in arguments, tags=tags, memory_type=kind, importance=float(i) if (i := get("importance", (int, float))) is not None else None, source_session=get("source_session", str))}
        if name == "mem_recall":
            kind = get("memory_type", str)
            return rows(self.recall(get("query", str, ""), get("limit", int, schema.RECALL_LIMIT), tags, lenient_time(get("since", str)), kind.lower() if kind and kind.lower() in schema.MEMORY_TYPES else None))
        if name == "mem_search":
            return rows(self.search(get("query", str, ""), get("limit", int, schema.SEARCH_LIMIT), tags))
        if name == "mem_update":
            self.update(get("id", str, ""), get("content", str), get("importance", (int, float)), tags if "tags" in arguments else None)
            return {"id": get("id", str)}
        if name == "mem_forget":
            return {"forgotten": self.forget(get("id", str, ""), get("mode", str, "delete"))}
        if name == "mem_consolidate":
            return asdict(self.consolidate(get("session_id", str, "")))
        raise LookupError(f"no tool {name}")


def lenient_time(text: str | None) -> str | None:
    """A time without zone, in UTC, for a text that states one; anything else is no time."""
    if not text:
        return None
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return (at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at).isoformat(sep=" ")
