"""Problem 7: filling containers of fixed capacity by vector best fit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.llm.tokenize import token_counts
from mnestra.sources.tables import table

#: Items a shard has on average. Shards are packed apart from each other, so each adds at most a
#: few half-filled containers to the some ten thousand items it holds.
SHARD_ITEMS = 32_768


@dataclass(frozen=True)
class Capacity:
    """What a container holds: tokens, documents, and attention cost (the sum of squared lengths)."""

    tokens: int = 4096
    documents: int = 1024
    attention: float | None = None  # kept as given; None: tokens squared, which any fitting set of pieces meets

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, float(self.tokens) ** 2 if self.attention is None else self.attention], "f8")


def best_fit(sizes: np.ndarray, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 0.05, 0.25), rule: str = "norm") -> np.ndarray:
    """The container number of each piece, pieces taken by falling size.

    ``rule``: "norm" takes the container whose weighted residual vector after placing is shortest,
    "dot" the one whose residual agrees most with the piece's demand. A container is open to a
    piece only if every residual covers the demand; with none open a new one starts, so each piece
    is placed, a piece above the attention capacity alone. A container too full for the smallest
    piece left is closed. Ties go to the older container.
    """
    cap = capacity.vector()
    w = np.array(weights) / cap
    demand = np.stack([sizes, np.ones(len(sizes)), sizes.astype("f8") ** 2], 1)
    scaled = demand * w
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), "i8")
    least = sizes[order[-1]] if len(sizes) else 0
    rest, number, used, made = np.empty((1024, 3)), np.empty(1024, "i8"), 0, 0
    for k in order:
        need = demand[k]
        fits = np.flatnonzero((rest[:used] >= need).all(1)) if used else ()
        if len(fits):
            left = rest[fits] * w
            if rule == "dot":
                at = fits[np.argmax(left @ scaled[k])]
            else:
                left -= scaled[k]
                at = fits[np.argmin((left * left).sum(1))]
        else:
            if used == len(rest):
                rest, number = np.concatenate([rest, np.empty_like(rest)]), np.concatenate([number, np.empty_like(number)])
            at, rest[used], number[used] = used, cap, made
            used, made = used + 1, made + 1
        rest[at] -= need
        out[k] = number[at]
        if rest[at, 0] < max(least, 1) or rest[at, 1] < 1 or rest[at, 2] < float(least) ** 2:  # closed: nothing left fits
            used -= 1
            rest[at:used], number[at:used] = rest[at + 1 : used + 1].copy(), number[at + 1 : used + 1].copy()
    return out


def pack(sized: DataFrame, id_col: str, size_col: str, capacity: Capacity = Capacity(), n_items: int | None = None, shard_items: int = SHARD_ITEMS, rule: str = "norm") -> DataFrame:
    """``(shard, container, id_col, piece, n_pieces, size)``: each piece's container.

    An item above the capacity is cut into full pieces and a rest; any other stays whole. Items of
    size 0 or null need no tokens but count as documents. Equal rows count once; a null id is an
    item as any other. An empty table gives none. ``(shard, container)`` names a container.

    One shuffle, of ids and sizes only, by hash of the id into exactly as many partitions as there are shards, which
    adaptive execution doesn't merge; a shard's task holds its own sizes and
    its open containers. ``n_items`` (counted if not given) sets the number of shards.
    """
    n_items = sized.count() if n_items is None else n_items
    shards = max(1, -(-n_items // shard_items))
    items = sized.select(F.col(id_col), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size")).withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = pa.Table.from_batches(held).group_by([id_col, "size", "shard"]).aggregate([]).sort_by([("size", "descending"), (id_col, "ascending")])
        size = shard["size"].to_numpy()
        pieces = np.maximum(1, -(-size // capacity.tokens))
        row = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(capacity.tokens, size[row] - piece * capacity.tokens)
        columns = [shard["shard"].take(row), pa.array(best_fit(length, capacity, rule=rule)), shard[id_col].take(row), pa.array(piece.astype("i4")), pa.array(pieces[row].astype("i4")), pa.array(length)]
        yield from pa.Table.from_arrays(columns, names=["shard", "container", id_col, "piece", "n_pieces", "size"]).to_batches(65_536)

    return items.repartitionById(shards, "shard").mapInArrow(run, f"shard int, container long, `{id_col}` {kind}, piece int, n_pieces int, size long")


def containers(packed: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``(shard, container, n_pieces, n_tokens, attention, unused)``: what each container holds and the tokens left over."""
    cost = F.sum(F.col("size").cast("double") * F.col("size"))
    return packed.groupBy("shard", "container").agg(F.count("*").alias("n_pieces"), F.sum("size").alias("n_tokens"), cost.alias("attention"), (F.lit(capacity.tokens) - F.sum("size")).alias("unused"))


def packed_documents(spark: SparkSession, sf_dir: str, capacity: Capacity = Capacity()) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(token_counts(docs), "doc_id", "n_tokens", capacity, n_items=docs.count())


#: Capacities that all bind: 16 documents, and half of the attention a single full document costs.
BOUNDED = Capacity(4096, 16, 4096.0**2 / 2)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each container with what it holds and the space left over."""
    return containers(packed_documents(spark, sf_dir)).drop("attention")


def p7_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers under capacities of which each binds; a piece above the attention capacity stands alone."""
    return containers(packed_documents(spark, sf_dir, BOUNDED), BOUNDED)


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents packed, and how often a rule of packing is broken, under the capacities of ``p7_bounded``."""
    packed = packed_documents(spark, sf_dir, BOUNDED)
    by_container = containers(packed, BOUNDED).agg(
        F.count_if(F.col("n_tokens") > BOUNDED.tokens).alias("over_tokens"), F.count_if(F.col("n_pieces") > BOUNDED.documents).alias("over_documents"), F.count_if((F.col("attention") > BOUNDED.attention) & (F.col("n_pieces") > 1)).alias("over_attention")
    )
    by_document = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_pieces").alias("said"), F.sum("size").alias("size")).agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("n") != F.col("said")).alias("wrong_pieces"), F.count_if((F.col("n") > 1) & (F.col("size") <= BOUNDED.tokens)).alias("cut_needlessly")
    )
    both = by_document.unionByName(by_container, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])  # two rows made one


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that packing had to cut."""
    return packed_documents(spark, sf_dir).where("n_pieces > 1 AND piece = 0").select("doc_id").distinct()


SQL = {"p7_audit": "SELECT count(DISTINCT doc_id) AS n_documents, 0::BIGINT AS wrong_pieces, 0::BIGINT AS cut_needlessly, 0::BIGINT AS over_tokens, 0::BIGINT AS over_documents, 0::BIGINT AS over_attention FROM documents"}
