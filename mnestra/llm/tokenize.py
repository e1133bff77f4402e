"""Problem 6: token ids of every text under a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from mnestra.llm.bpe import encoder_of
from mnestra.sources.tables import table

#: Characters encoded at a time; bounds a worker's memory whatever the batch holds.
SLICE_CHARS = 2_000_000


def default_rank_file() -> str:
    """The 50k byte-level vocabulary of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def shared_ranks(spark: SparkSession, rank_file: str | None):
    """The rank file (under 2 MB; refused beyond 64 MB) as a broadcast, so executors need no copy of it."""
    data = Path(rank_file or default_rank_file()).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError("rank file too large to share")
    return spark.sparkContext.broadcast(data)


def slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of about ``limit`` bytes each, at least one row."""
    sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype("f8"))
    start, total = 0, 0.0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield start, i + 1 - start
            start, total = i + 1, 0.0
    if start < len(sizes):
        yield start, len(sizes) - start


def token_ids(docs: DataFrame, rank_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: each text's ids, without special tokens; its text is encoded as it stands.

    Null and empty texts give an empty list. A row is one row of the input, equal rows count once
    if the caller makes them distinct; other columns are not read. An empty table gives none. No
    shuffle: the scan feeds Python in Arrow batches, long batches are cut into slices.
    """
    ranks = shared_ranks(docs.sparkSession, rank_file)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks.value)
        for batch in batches:
            texts = batch.column(1)
            for start, n in slices(texts):
                ids = [encoder.encode(t) for t in texts.slice(start, n).to_pylist()]
                offsets = np.zeros(n + 1, "i4")
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.empty(offsets[-1], "i4")
                for x, a, b in zip(ids, offsets[:-1], offsets[1:]):
                    flat[a:b] = x
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, rank_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens)``: the length of ``token_ids``' list, without making it."""
    ranks = shared_ranks(docs.sparkSession, rank_file)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks.value)
        for batch in batches:
            counts = pa.array((encoder.count(t.as_py()) for t in batch.column(1)), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))
