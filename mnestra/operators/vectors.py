"""Exact vector search: distances in Arrow batches, a top-k in each, and a top-k of these."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnestra.sources.tables import reference_key

#: Query vectors come from the caller and travel with the task; more than this many go in several calls.
MOST_QUERIES = 10_000
#: Batch rows times queries worked on at a time.
_CELLS = 2_000_000


def live(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """``(id, embedding)`` that aren't deleted and have ``dim`` components.

    Searches leave out vectors with a null or non-finite component and count an id once; where that matters elsewhere, see ``finite``.
    """
    rows = vectors.where((~F.coalesce("deleted", F.lit(False))) & (F.size("embedding") == dim)).select(reference_key(F.col("id")).alias("id"), "embedding")
    return rows.where("id IS NOT NULL")


def finite(v: Column) -> Column:
    """Whether no component is null, NaN or infinite; searches see to it in their batches."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def query_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST_QUERIES) -> list[tuple]:
    """Query vectors for ``nearest``, at most ``most``."""
    out = [(r[0], list(r[1])) for r in rows.select(key, vector).orderBy(key).limit(most + 1).collect()]
    if len(out) > most:
        raise ValueError(f"more than {most} query vectors")
    return out


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared L2 distance, or 1 - inner product, of two arrays of one length, in double."""
    if metric == "ip":
        return F.lit(1.0) - F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)


def normalised(v: Column) -> Column:
    """Divided by its length in double; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


#: Pairs measured at a time.
_PAIRS = 65_536


def _may_count(x: np.ndarray, q: np.ndarray, ids: np.ndarray, metric: str, k: int | None, radius: float | None) -> tuple[np.ndarray, np.ndarray]:
    """``(query, row)`` of all pairs that may be among a query's k nearest ids or within the radius, by one matrix product.

    The product's rounding is allowed for; whoever asks measures what is left.
    """
    dots = q @ x.T
    if metric == "ip":
        near, slack = 1.0 - dots, 1e-12 * (1.0 + np.abs(dots).max(initial=0))
    else:
        xx, qq = (x * x).sum(1), (q * q).sum(1)
        near, slack = qq[:, None] - 2.0 * dots + xx[None, :], 1e-12 * (1.0 + xx.max(initial=0) + qq.max(initial=0))
    keep = np.ones(near.shape, bool) if radius is None else near <= radius + slack
    if k is not None and k < len(x):
        best = near
        if len(np.unique(ids)) < len(ids):  # of several vectors of an id the nearest counts
            order = np.argsort(ids, kind="stable")
            best = np.minimum.reduceat(near[:, order], np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0]), axis=1)
        if k < best.shape[1]:
            keep &= near <= np.partition(best, k - 1, axis=1)[:, k - 1 : k] + slack
    return np.nonzero(keep)


def scored(vectors: DataFrame, queries: Sequence[tuple], metric: str = "l2", k: int | None = None, radius: float | None = None, once: bool = True) -> DataFrame:
    """``(query, id, distance)``; with ``k`` at least each query's k nearest ids, with ``radius`` those within it.

    Queries travel with the task, so nothing is joined, and no vector is shuffled. In a batch only
    what can be among the k nearest goes on: at most k ids for each query and batch, with ties at
    the edge. Of several vectors of an id the nearest counts; without ``once`` they all come.
    """
    if not queries:
        return vectors.sparkSession.createDataFrame([], "query string, id string, distance double")
    q = np.array([v for _, v in queries], "f8")
    names = pa.array([str(n) for n, _ in queries], pa.string())
    if len(names) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} query vectors")
    dim = q.shape[1]
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _CELLS // len(names))
        for whole in batches:
            if not pc.all(pc.equal(pc.list_value_length(whole.column(1)), dim)).as_py() and whole.num_rows:
                raise ValueError(f"a vector has not {dim} components as the queries have")
            for s in range(0, whole.num_rows, step):
                batch = whole.slice(s, step)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
                good = np.isfinite(x).all(1)
                if not good.all():
                    x, batch = x[good], batch.filter(pa.array(good))
                if not batch.num_rows:
                    continue
                ids = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                which, rows = _may_count(x, q, ids, metric, k, radius)
                for t in range(0, len(rows), _PAIRS):
                    i, j = which[t : t + _PAIRS], rows[t : t + _PAIRS]
                    d = 1.0 - (x[j] * q[i]).sum(1) if metric == "ip" else ((x[j] - q[i]) ** 2).sum(1)
                    if radius is not None:
                        i, j, d = i[d <= radius], j[d <= radius], d[d <= radius]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), batch.column(0).take(pa.array(j)), pa.array(d)], names=["query", "id", "distance"])

    found = vectors.select("id", "embedding").mapInArrow(run, f"query string, id {kind}, distance double")
    return found.groupBy("query", "id").agg(F.min("distance").alias("distance")) if once else found


def nearest(vectors: DataFrame, queries: Sequence[tuple], k: int, metric: str = "l2", digits: int = 9) -> DataFrame:
    """``(query, rank, id, distance, similarity)``: each query's k nearest; ties go to the smaller id.

    Distances are rounded to ``digits`` before they are compared, so that equal ones tie.
    """
    rows = scored(vectors, queries, metric, k).withColumn("distance", F.round("distance", digits))
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "distance", similarity(F.col("distance")).alias("similarity"))


def within(vectors: DataFrame, queries: Sequence[tuple], radius: float, most: int | None = None, digits: int = 9, ranked: bool = False) -> DataFrame:
    """``(query, id, distance, similarity)`` of all within ``radius``; with ``most`` the nearest of them, with their ``rank``.

    Without ``most`` a query's hits are unbounded and nothing puts them in one task; ``ranked`` asks for their rank all the same, where
    they are known to be few. A least number of candidates, as graph indexes need to stop late enough, has no meaning here: all are measured.
    """
    rows = scored(vectors, queries, k=most, radius=radius).withColumn("distance", F.round("distance", digits))
    out = rows.select("query", "id", "distance", similarity(F.col("distance")).alias("similarity"))
    if most is None and not ranked:
        return out
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "id")))
    return (out if most is None else out.where(F.col("rank") <= most)).select("query", "rank", "id", "distance", "similarity")


def nearest_documents(vectors: DataFrame, documents: DataFrame, queries: Sequence[tuple], n: int, digits: int = 9) -> DataFrame:
    """``(query, rank, document, distance)``: the n documents whose nearest vector is nearest.

    ``documents`` has ``(id, document)``; vectors of no document are left out. Vectors are put to their documents first; then
    each batch keeps what can be among the n nearest documents, by their nearest vectors.
    """
    owned = vectors.join(documents.where("document IS NOT NULL").select("id", "document"), "id").select(F.col("document").alias("id"), "embedding")
    return nearest(owned, queries, n, digits=digits).select("query", "rank", F.col("id").alias("document"), "distance")


def get(vectors: DataFrame, id: str) -> DataFrame:
    """The live vectors of an id, equal ones once; none if it is unknown or deleted."""
    return vectors.where(F.col("id") == reference_key(F.lit(id))).distinct()


def index_size(vectors: DataFrame) -> DataFrame:
    """One row ``(n_vectors, n_deleted)``: rows of the table, deleted ones too, equal rows once."""
    rows = vectors.select("id", "embedding", F.coalesce("deleted", F.lit(False)).alias("deleted")).distinct()
    return rows.agg(F.count("*").alias("n_vectors"), F.count_if("deleted").alias("n_deleted"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors with ``new`` ones in place of old ones of the same id; a deleted id comes back."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy(F.desc("_new")))).where("_k = 1").drop("_k", "_new")


def removed(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows, those named in ``ids`` marked as deleted."""
    named = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return vectors.join(named, "id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_hit").select(vectors.columns)
