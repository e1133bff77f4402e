"""Embedders and the word-piece tokenizer, as plain functions and as Arrow UDFs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """``distinct``: whether texts that say other things lie apart, so that near vectors mean like texts."""

    dim: int
    distinct: bool

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray: ...


class MockEmbedder:
    """(1, 0, ...) for any text, all zero for an empty or null one."""

    distinct = False

    def __init__(self, dim: int = 768):
        self.dim = dim

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), "f4")
        out[:, 0] = [1.0 if t else 0.0 for t in texts]
        return out


class HashEmbedder:
    """Of component i: the text's byte i (round about, signed) over 255, plus sin(i / 10); scaled to length 1.

    Empty and null texts give zeros.
    """

    distinct = False

    def __init__(self, dim: int = 768):
        self.dim = dim
        self._wave = np.array([math.sin(0.1 * i) for i in range(dim)], "f4")

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), "f4")
        for row, text in enumerate(texts):
            if text:
                raw = np.frombuffer(text.encode(), "i1").astype("f4")
                out[row] = np.resize(raw, self.dim) / np.float32(255) + self._wave
        length = np.sqrt((out.astype("f8") ** 2).sum(1, keepdims=True))
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0).astype("f4")


class TableEmbedder:
    """Vectors of known texts; any other text has the last unit vector."""

    distinct = True

    def __init__(self, known: dict[str, Sequence[float]], dim: int):
        self.known, self.dim = known, dim

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        other = [0.0] * (self.dim - 1) + [1.0]
        return np.array([self.known.get(t, other) for t in texts], "f4").reshape(-1, self.dim)


def embed(rows: DataFrame, embedder: Embedder, text: str = "content", out: str = "embedding") -> DataFrame:
    """Rows with the embedding of a text column, made in Arrow batches."""

    @F.arrow_udf("array<float>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            x = embedder.embed_batch(batch.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, embedder.dim, dtype="i4")), pa.array(x.ravel()))

    return rows.withColumn(out, run(F.col(text)))


def mock_embedding(text: Column, dim: int = 768) -> Column:
    """``MockEmbedder`` as an expression."""
    first = F.when(F.length(F.coalesce(text, F.lit(""))) > 0, 1.0).otherwise(0.0).cast("float")
    return F.concat(F.array(first), F.array_repeat(F.lit(0.0).cast("float"), dim - 1))


def read_vocabulary(path: str) -> dict[str, int]:
    """A token a line; its number is the line's, blank lines count. Read on the driver, whose lines are in order."""
    return {token: i for i, line in enumerate(Path(path).read_text(encoding="utf-8").split("\n")) if (token := line.rstrip("\r"))}


class WordPiece:
    """Basic tokens (blanks and ASCII punctuation apart, ASCII letters lower), then the longest pieces from the left.

    Work is on bytes. A token with a part that isn't in the vocabulary is one [UNK]. Ids are cut to
    ``length`` with [CLS] and [SEP] and filled up with [PAD].
    """

    def __init__(self, vocabulary: dict[str, int], length: int = 512):
        self.pieces = {t.encode(): i for t, i in vocabulary.items()}
        self.length = length
        get = vocabulary.get
        self.unk, self.cls, self.sep, self.pad = get("[UNK]", 100), get("[CLS]", 101), get("[SEP]", 102), get("[PAD]", 0)
        self.longest = max(map(len, self.pieces), default=0)

    def basic(self, text: str) -> list[bytes]:
        out, word = [], bytearray()
        for b in text.encode():
            if b in b" \t\n\r\x0b\x0c" or chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                if word:
                    out.append(bytes(word))
                    word.clear()
                if b not in b" \t\n\r\x0b\x0c":
                    out.append(bytes([b]))
            else:
                word.append(b + 32 if 65 <= b <= 90 else b)
        return [*out, bytes(word)] if word else out

    def pieces_of(self, token: bytes) -> list[int]:
        out, at = [], 0
        while at < len(token):
            lead = b"##" if at else b""
            for end in range(min(len(token), at + self.longest), at, -1):
                number = self.pieces.get(lead + token[at:end])
                if number is not None:
                    out.append(number)
                    at = end
                    break
            else:
                return [self.unk]
        return out

    def encode(self, text: str | None) -> list[int]:
        ids = [self.cls]
        for token in self.basic(text or ""):
            ids += self.pieces_of(token)
            if len(ids) >= self.length:
                break
        ids = [*ids[: self.length - 1], self.sep]
        return ids + [self.pad] * (self.length - len(ids))


def word_piece_ids(text: Column, tokenizer: WordPiece) -> Column:
    """``array<bigint>`` of ids; null texts are encoded as empty ones."""

    @F.arrow_udf("array<bigint>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([tokenizer.encode(t) for t in batch.to_pylist()], pa.list_(pa.int64()))

    return run(text)


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: (i != 0).cast("int"))
