"""Problem 1: how often each term occurs and in how many records, from bitmaps in vertical layout.

Records have numbers of their own (``records.numbered_records``). A term's bitmap is a set of containers, one for each
chunk of 65,536 record numbers, each kept in the smallest of three forms: a sorted list of 16-bit
numbers, runs, or 8 KB of bits. Beside each container stands the count of occurrences. Containers
of one term and chunk are merged by union, in the task that makes them and behind the shuffle; a
term's document frequency is the sum of its merged containers' cardinalities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.llm.records import RECORDS_SQL, numbered_records, record_count
from mnestra.sources.tables import table

RUN_BITS = 16
LIST, BITS, RUNS = b"L", b"B", b"R"


def pack_container(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit numbers in the smallest form."""
    low = low.astype("<u2")
    breaks = np.flatnonzero(np.diff(low.astype("i4")) != 1)
    n_runs = len(breaks) + 1 if len(low) else 0
    size = min(2 * len(low), 4 * n_runs, 8192)
    if size == 2 * len(low):
        return LIST + low.tobytes()
    if size == 4 * n_runs:
        starts, ends = low[np.concatenate([[0], breaks + 1])], low[np.concatenate([breaks, [len(low) - 1]])]
        return RUNS + np.stack([starts, ends], 1).astype("<u2").tobytes()
    bits = np.zeros(1 << RUN_BITS, bool)
    bits[low] = True
    return BITS + np.packbits(bits).tobytes()


def unpack_container(data: bytes) -> np.ndarray:
    form, body = data[:1], data[1:]
    if form == LIST:
        return np.frombuffer(body, "<u2")
    if form == RUNS:
        ends = np.frombuffer(body, "<u2").reshape(-1, 2).astype("i4")
        return np.concatenate([np.arange(a, b + 1) for a, b in ends]).astype("<u2") if len(ends) else np.zeros(0, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, "u1"))).astype("<u2")


def union_containers(a: bytes, b: bytes) -> bytes:
    return pack_container(np.union1d(unpack_container(a), unpack_container(b)))


def cardinality(data: bytes) -> int:
    form = data[:1]
    if form == LIST:
        return (len(data) - 1) // 2
    if form == BITS:
        return int(np.unpackbits(np.frombuffer(data[1:], "u1")).sum())
    return len(unpack_container(data))


_SHAPE = "term string, chunk long, container binary, cardinality long, n_occurrences long"


def _containers(terms: np.ndarray, low: np.ndarray, names: list[str]) -> Iterator[tuple[str, bytes, int]]:
    """Each term's container and occurrences in one chunk: ``terms`` are codes into ``names``, ``low`` the records' low bits."""
    key, times = np.unique(terms.astype("i8") << RUN_BITS | low, return_counts=True)
    term = key >> RUN_BITS
    at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(key) else np.zeros(0, "i8")
    total = np.add.reduceat(times, at) if len(at) else times
    for a, b, n in zip(at, np.append(at[1:], len(key)), total.tolist()):
        yield names[term[a]], pack_container((key[a:b] & 0xFFFF).astype("<u2")), n


#: Terms of one chunk a task holds before it puts its containers out; what follows is merged with them later.
MOST_HELD = 1_000_000


def term_bitmaps(records: DataFrame, most_held: int = MOST_HELD) -> DataFrame:
    """``(term, chunk, container, cardinality, n_occurrences)`` of ``(number, terms)`` rows; a chunk's rows may come in any order and from any task.

    Null and empty term lists, null terms and null numbers give nothing. A record's repeated term is one bit and as many
    occurrences. A task merges the containers of a chunk by union as batches come, and puts them out when another chunk begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[bytes, int]] = {}
        chunk = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield _held([(term, chunk, data, n) for term, (data, n) in held.items()])
                held.clear()

        for batch in batches:
            number, lists = batch.column(0).to_numpy(), batch.column(1)
            flat = lists.flatten().dictionary_encode()
            lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype("f8")).astype("i8")
            names, codes, record = flat.dictionary.to_pylist(), flat.indices.to_numpy(), np.repeat(number, lengths)
            for part in np.unique(record >> RUN_BITS).tolist():
                if part != chunk or len(held) > most_held:
                    yield from flush()
                    chunk = part
                mine = record >> RUN_BITS == part
                for term, data, n in _containers(codes[mine], record[mine] & 0xFFFF, names):
                    old = held.get(term)
                    held[term] = (data, n) if old is None else (union_containers(old[0], data), old[1] + n)
        yield from flush()

    return records.where("number IS NOT NULL").select("number", F.filter("terms", lambda t: t.isNotNull()).alias("terms")).mapInArrow(run, _SHAPE)


def merge_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Union of bitmaps of several sources with one numbering: one container for each term and chunk.

    Occurrences add up. A hot term is spread over its chunks; equal keys are sorted together and
    merged as they stream by, two containers at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for term, chunk, data, _, n in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[:2] == (term, chunk):
                    held = (term, chunk, union_containers(held[2], data), held[3] + n)
                else:
                    out += [held] if held else []
                    held = (term, chunk, data, n)
            yield _held(out)
        yield _held([held] if held else [])

    return bitmaps.repartition("term", "chunk").sortWithinPartitions("term", "chunk").mapInArrow(run, _SHAPE)


def _held(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([cardinality(r[2]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
        names=["term", "chunk", "container", "cardinality", "n_occurrences"],
    )


def term_frequencies(bitmaps: DataFrame, total: Column, rare_below: int = 3, common_share: float = 0.1) -> DataFrame:
    """``(tag, n_occurrences, n_records, verdict)`` of every term of an index.

    Bitmaps are merged by union first; a term is in as many records as its merged containers have members,
    which are summed before the shuffle on the term.

    ``verdict``: `rare` in fewer than ``rare_below`` records, `common` in more than ``common_share``
    of ``total``, else null; rare goes first. An empty table gives none.
    """
    terms = merge_bitmaps(bitmaps).groupBy(F.col("term").alias("tag")).agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("cardinality").alias("n_records"))
    verdict = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_share * total, "common")
    return terms.withColumn("verdict", verdict)


def members(bitmaps: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(term, record)`` of an index: its bits under the names of ``numbers`` ``(record, number)``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for term, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("term", "chunk", "container"))):
                low = unpack_container(data).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(term, pa.string()), len(low)), pa.array(low | chunk << RUN_BITS)], names=["term", "number"])

    bits = merge_bitmaps(bitmaps).mapInArrow(run, "term string, number long")
    return bits.join(numbers.select("record", "number"), "number").select("term", "record")


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    memories = table(spark, sf_dir, "memories")
    numbered = numbered_records(memories)
    return memories, numbered, term_bitmaps(numbered)


def p1_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertical index itself, a container a row, summed up by tag: what its bitmaps hold."""
    return merge_bitmaps(_index(spark, sf_dir)[2]).groupBy(F.col("term").alias("tag")).agg(F.sum("cardinality").alias("n_records"), F.sum("n_occurrences").alias("n_occurrences"))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records the index' bits stand for."""
    _, numbered, bitmaps = _index(spark, sf_dir)
    return members(bitmaps, numbered).select(F.col("term").alias("tag"), "record")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories, _, bitmaps = _index(spark, sf_dir)
    return term_frequencies(bitmaps, record_count(memories))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("verdict IS NOT NULL").select("tag", "verdict")


_TERMS_SQL = f"""WITH {RECORDS_SQL},
  terms AS (SELECT tag, count(*) AS n_occurrences, count(DISTINCT record) AS n_records FROM spelt GROUP BY tag)
SELECT tag, n_occurrences, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > cast(0.1 AS double) * n THEN 'common' END AS verdict FROM terms, total"""

_MEMBERS_SQL = f"WITH {RECORDS_SQL} SELECT DISTINCT tag, record FROM spelt"

SQL = {"p1_members": _MEMBERS_SQL, "p1_terms": _TERMS_SQL, "p1_bitmaps": f"SELECT tag, n_records, n_occurrences FROM ({_TERMS_SQL})", "p1_found": f"SELECT tag, verdict FROM ({_TERMS_SQL}) WHERE verdict IS NOT NULL"}
