"""Problem 3: the most similar vectors of every vector, by a permutation index and an exact scan for what it leaves open.

A vector is represented by its nearest pivots in order. It is posted in the inverted file of each
pair of leading pivots. Vectors that meet in an inverted file are ranked by the footrule distance
of their pivot orders; each vector's best candidates are measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnestra.operators.skew import join_unique
from mnestra.sources.tables import ensure_checkpoint_dir, reference_key, table


@dataclass(frozen=True)
class IndexConfig:
    """Parameters of the index.

    ``pivots``: None takes 12 times the square root of the number of rows, a power of two from 64
    to 16,384 (at most 4 MB for 64 components). ``sample``: vectors sent to the driver, from which
    pivots, the footrule bound and crowded inverted files are known; the smallest hashes of ids, so it doesn't depend on
    order. ``order``: pivots kept of a permutation, a multiple of 4. ``reach``: leading positions i < j are posted
    together if i + j is at most this. ``keep``: candidates of each vector, those of least footrule
    distance, that are measured. ``footrule``: share of the largest footrule distance beyond which a pair is not
    worth ranking; None takes the distance that 95 of 100 pairs at the least similarity asked
    for don't exceed, by the sample. ``list_size``: members of an inverted file beyond which it is split
    into blocks that meet pair by pair in tasks of their own.
    """

    pivots: int | None = None
    sample: int = 16_384
    order: int = 24
    reach: int = 7
    keep: int = 24
    footrule: float | None = None
    list_size: int = 16_384
    seed: int = 7


def usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of ``embedding`` that aren't deleted, have ``dim`` finite components and aren't all zero."""
    vectors, deleted = batch.column("embedding"), batch.column("deleted")
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    mask = pc.and_(right, pc.invert(pc.fill_null(deleted, False)))
    rows = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype("f4").reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype("f8")
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 / (1 + L2²) of unit vectors, row by row."""
    d = a - b
    return 1 / (1 + (d * d).sum(1))


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Footrule distance of rows of pivot orders; a pivot that is missing counts as one place behind the last.

    With weights (order - place, 0 if missing) it is the sum of both weights less twice the common minimum.
    """
    order = a.shape[1]
    common = np.zeros(len(a), "i4")
    for i in range(order):
        for j in range(order):
            common += (a[:, i] == b[:, j]) * np.int32(order - max(i, j))
    return order * (order + 1) - 2 * common


class PermutationIndex:
    """Pivots, footrule bound and crowded inverted files, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, n_rows: int, config: IndexConfig, floor: float = 0.8):
        self.config, self.dim = config, sample.shape[1]
        wanted = config.pivots or 1 << max(6, min(14, round(np.log2(12 * max(n_rows, 1) ** 0.5))))
        n_sample, sample = len(sample), unit(sample)
        sample = sample[np.sort(np.unique(sample.round(6), axis=0, return_index=True)[1])]  # copies crowd no inverted file
        self.pivots = sample[:wanted].astype("f4")
        self.posted = [(i, j) for i, j in combinations(range(min(config.order, len(self.pivots))), 2) if i + j <= config.reach]
        self.blocks: dict[int, int] = {}
        orders = self.permute(sample.astype("f4"))
        self.limit = int(self.bound(sample, orders, floor) if config.footrule is None else config.footrule * config.order * (config.order + 1))
        keys, counts = np.unique(self.keys(orders), return_counts=True)
        for key, n in zip(keys, counts):
            size = n * n_rows / max(n_sample, 1)
            if n > 8 and size > config.list_size:
                self.blocks[int(key)] = int(-(-size // config.list_size))

    def bound(self, sample: np.ndarray, orders: np.ndarray, floor: float, most: int = 4096) -> float:
        """The footrule distance that 95 of 100 pairs of similarity ``floor`` keep, nearer pairs more often, from sample vectors moved that far."""
        x = sample[:most]
        if floor <= 0.2 or x.shape[1] < 2:  # nothing is farther than opposite vectors
            return self.config.order * (self.config.order + 1)
        aside = np.random.default_rng(self.config.seed).standard_normal(x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        aside /= np.maximum(np.sqrt((aside * aside).sum(1, keepdims=True)), 1e-12)
        cosine = 1 - (1 / floor - 1) / 2
        moved = self.permute((cosine * x + (1 - cosine * cosine) ** 0.5 * aside).astype("f4"))
        return float(np.quantile(footrule(orders[: len(x)], moved), 0.95, method="higher"))

    def permute(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivots of each row in order; fewer pivots than places leave -1 at the end."""
        order = min(self.config.order, len(self.pivots))
        out = np.full((len(x), self.config.order), -1, "i2")
        for s in range(0, len(x), 1024):
            near = -(x[s : s + 1024] @ self.pivots.T)
            first = np.argpartition(near, order - 1, 1)[:, :order] if order < near.shape[1] else np.tile(np.arange(order), (len(near), 1))
            d = np.take_along_axis(near, first, 1)
            out[s : s + 1024, :order] = np.take_along_axis(first, np.lexsort((first, d), axis=1), 1)
        return out

    def keys(self, permutations: np.ndarray) -> np.ndarray:
        """The inverted files of each row; with one pivot all rows share one."""
        p = permutations.astype("i8")
        if not self.posted:
            return np.zeros((len(p), 1), "i8")
        return np.stack([np.minimum(p[:, i], p[:, j]) << 14 | np.maximum(p[:, i], p[:, j]) for i, j in self.posted], 1)

    def post(self, refs: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Columns of the postings of ``x``: key, ref, the permutation's words."""
        perms = self.permute(x)
        words, keys = perms.astype("<i2").view("<i8"), self.keys(perms)
        row = np.repeat(np.arange(len(x)), keys.shape[1])
        key = keys.ravel() << 32
        if self.blocks:
            n_blocks = np.array([self.blocks.get(int(k), 1) for k in keys.ravel()])
            crowded = np.flatnonzero(n_blocks > 1)
            if len(crowded):  # member of block b goes to the cells (b, j) of its file for every j
                own = refs[row[crowded]].astype("u8") % n_blocks[crowded].astype("u8")
                times = n_blocks[crowded]
                j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                b = np.repeat(own.astype("i8"), times)
                cell = np.minimum(b, j) << 16 | np.maximum(b, j)
                plain = n_blocks == 1
                key, row = np.concatenate([key[plain], np.repeat(key[crowded], times) | cell]), np.concatenate([row[plain], np.repeat(row[crowded], times)])
        return [key, refs[row], *words[row].T]

    def meet(self, columns: list[np.ndarray], most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of refs (smaller first) that share an inverted file, with their footrule distance if it is within the bound.

        A pair is put out by the first of its common files only. ``columns`` are postings sorted by key,
        whole files only; ``most`` pairs are held at a time.
        """
        key, ref = columns[0], columns[1]
        perms = np.ascontiguousarray(np.stack(columns[2:], 1)).view("<i2")[:, : self.config.order]
        ends = np.searchsorted(key, key, "right")
        partners = ends - np.arange(len(key)) - 1
        upto = np.cumsum(partners)
        start = 0
        while start < len(key):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
            n = partners[start:stop]
            a = np.repeat(np.arange(start, stop), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            other = ref[a] != ref[b]
            a, b = a[other], b[other]
            distance = footrule(perms[a], perms[b])
            near = np.flatnonzero(distance <= self.limit)
            near = near[self._first(key[a[near]], ref[a[near]], ref[b[near]], perms[a[near]], perms[b[near]])]
            a, b = ref[a[near]], ref[b[near]]
            yield np.minimum(a, b), np.maximum(a, b), distance[near]
            start = stop

    def _first(self, key: np.ndarray, ref_a: np.ndarray, ref_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ``key`` is where a pair is put out: the least common file, of a split one the cell of both blocks."""
        ka, kb = self.keys(a), self.keys(b)
        least = np.full(len(key), 1 << 62)
        for i in range(ka.shape[1]):
            least = np.where((ka[:, i : i + 1] == kb).any(1), np.minimum(least, ka[:, i]), least)
        here = least == key >> 32
        if self.blocks:
            n = np.array([self.blocks.get(int(k), 1) for k in key >> 32], "u8")
            same = ref_a.astype("u8") % n == ref_b.astype("u8") % n  # members of one block meet in all its cells
            here &= ~same | ((key >> 16 & 0xFFFF) == (key & 0xFFFF))
        return here


def _keyed(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(reference_key(F.col("id")).alias("id"), "embedding", "deleted").where("id IS NOT NULL AND NOT coalesce(deleted, false)")
    return rows.withColumn("ref", F.xxhash64("id"))


def fit(vectors: DataFrame, n_rows: int | None = None, floor: float = 0.8, config: IndexConfig = IndexConfig(), dim: int = 64) -> PermutationIndex | None:
    """The index's parameters from a bounded sample; None if no vector is usable."""
    n_rows = vectors.count() if n_rows is None else n_rows
    size = max(config.sample, config.pivots or 0)
    # about twice the sample by its hashes first, so that no task sends its own top of that size
    below = F.lit(int(min(2**63 - 1, -(2**63) + 2**64 * 2 * size / max(n_rows, 1))))
    rows = _keyed(vectors).where((F.size("embedding") == dim) & (F.col("ref") <= below)).orderBy("ref").select("embedding", "deleted").limit(size).toArrow().to_batches()
    parts = [usable(b, dim)[1] for b in rows if b.num_rows]
    sample = np.concatenate(parts) if parts else np.zeros((0, dim), "f4")
    return PermutationIndex(sample, n_rows, config, floor) if len(sample) else None


def candidates(vectors: DataFrame, index: PermutationIndex, k: int = 5) -> DataFrame:
    """``(a, b, footrule)``: pairs of 64-bit refs of ids that may be among each other's ``k`` nearest.

    Of all that a vector meets within the footrule bound those with fewer than ``keep`` nearer ones are its candidates, so
    ties stay together; a pair goes on if either is the other's candidate. The rank's limit works before its shuffle. Of exact copies within a task only the ``k`` + 1 smallest ids are posted: a larger one has that many copies
    before it, so it is nobody's neighbour and its neighbours are its copies. Postings are grouped
    by one shuffle and stream by, file after file.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    n_words = -(-index.config.order // 4)
    names = ["key", "ref", *[f"p{i}" for i in range(n_words)]]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kept = shared.value, {}
        for batch in batches:
            rows, x = usable(batch, index.dim)
            ids = batch.column("id").take(pa.array(rows)).to_pylist()
            keep = np.ones(len(rows), bool)
            for i, (name, body) in enumerate(zip(ids, x)):
                smallest = kept.setdefault(xxhash.xxh128_digest(body.tobytes()), [])
                if name in smallest or (len(smallest) > k and name > smallest[-1]):
                    keep[i] = False
                else:
                    smallest.append(name)
                    smallest.sort()
                    del smallest[k + 1 :]
            refs = batch.column("ref").to_numpy()[rows[keep]]
            for s in range(0, len(refs), 4096):
                columns = index.post(refs[s : s + 4096], unit(x[keep][s : s + 4096]).astype("f4"))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = shared.value, None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0  # the last file may go on
            held = [c[cut:] for c in columns]
            yield from emit([c[:cut] for c in columns])
        if held is not None:
            yield from emit(held)

    def emit(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b, d in shared.value.meet(columns) if len(columns[0]) else ():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype("i4"))], names=["a", "b", "footrule"])

    postings = _keyed(vectors).mapInArrow(post, ", ".join(f"{c} long" for c in names))
    pairs = postings.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "a long, b long, footrule int")
    sides = F.explode(F.array(F.struct(F.col("a").alias("ref"), F.col("b").alias("other")), F.struct(F.col("b").alias("ref"), F.col("a").alias("other")))).alias("s")
    place = F.rank().over(W.partitionBy("ref").orderBy("footrule"))
    best = pairs.select("footrule", sides).select("s.*", "footrule").withColumn("place", place).where(F.col("place") <= index.config.keep)
    both = best.select(F.least("ref", "other").alias("a"), F.greatest("ref", "other").alias("b"), "footrule")
    return both.repartition("a").groupBy("a", "b").agg(F.min("footrule").alias("footrule"))  # one shuffle for this and the join on a


def _clean(vectors: DataFrame, dim: int) -> DataFrame:
    """``(ref, id, v)`` of usable vectors."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = usable(batch, dim)
            offsets = pa.array(np.arange(0, len(x) * dim + 1, dim, dtype="i4"))
            yield pa.RecordBatch.from_arrays([batch.column("ref").take(pa.array(rows)), batch.column("id").take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["ref", "id", "v"])

    return _keyed(vectors).mapInArrow(clean, "ref long, id string, v array<float>")


def reranked(pairs: DataFrame, vectors: DataFrame, floor: float, dim: int = 64) -> DataFrame:
    """``(id_a, id_b, similarity)`` of candidate pairs at or above ``floor``, with id_a < id_b, exactly.

    A ref two ids share stands for both: pairs are joined to all its vectors and judged by them. Of
    several vectors of an id the most similar counts.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (unit(batch.column(c).flatten().to_numpy().reshape(-1, dim)) for c in ("va", "vb"))
            s = similarity(x, y)
            good = pa.array(s >= floor)
            yield pa.RecordBatch.from_arrays([batch.column("id_a").filter(good), batch.column("id_b").filter(good), pa.array(s).filter(good)], names=["id_a", "id_b", "similarity"])

    side = _clean(vectors, dim)
    both = pairs.select("a", "b").join(side.select(F.col("ref").alias("a"), F.col("id").alias("id_a"), F.col("v").alias("va")), "a").join(side.select(F.col("ref").alias("b"), F.col("id").alias("id_b"), F.col("v").alias("vb")), "b")
    judged = both.where("id_a <> id_b").select("id_a", "id_b", "va", "vb").mapInArrow(judge, "id_a string, id_b string, similarity double")
    return judged.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def nearest(vectors: DataFrame, k: int = 5, floor: float = 0.8, config: IndexConfig = IndexConfig(), dim: int = 64) -> DataFrame:
    """``(id, rank, neighbour, similarity)``: up to ``k`` most similar ids of each, at similarity ``floor`` or more.

    Ids are compared without outer blanks and regard to case; null and blank ids, deleted, null,
    short, long, all-zero and non-finite vectors are left out; ties go to the smaller id; equal rows
    count once. The index is approximate: recall against brute force is measured in the tests. An
    id with more than ``k`` exact copies of smaller id may have no row; ``copies`` has it.
    """
    index = fit(vectors, floor=floor, config=config, dim=dim)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "id string, rank int, neighbour string, similarity double")
    exact = reranked(candidates(vectors, index, k), vectors, floor, dim)
    both = exact.select(F.col("id_a").alias("id"), F.col("id_b").alias("neighbour"), "similarity").unionByName(exact.select(F.col("id_b").alias("id"), F.col("id_a").alias("neighbour"), "similarity"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "neighbour", "similarity")


def copies(vectors: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """``(id, rank, neighbour, similarity)`` of ids with more than ``k`` exact copies of smaller id: the ``k`` smallest of these.

    Of a vector's ids only the k + 1 smallest of each task are shuffled; the rows of a vector that
    many ids share are joined to them in place.
    """
    rows = _clean(vectors, dim).select("id", F.struct(F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v")).alias("h2")).alias("copy"))
    place = F.dense_rank().over(W.partitionBy("copy").orderBy("id"))
    first = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("copy").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > k)
    late = join_unique(rows, first, "copy").where(F.col("id") > F.element_at("ids", k + 1)).select("id", F.posexplode(F.slice("ids", 1, k)).alias("pos", "neighbour"))
    return late.select("id", (F.col("pos") + 1).alias("rank"), "neighbour", F.lit(1.0).alias("similarity")).distinct()


def mutual(neighbours: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b, of ids that are each among the other's neighbours."""
    pair = neighbours.groupBy(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).agg(F.count("*").alias("n"))
    return pair.where("n = 2").select("id_a", "id_b")


#: More than the error of a product of two unit vectors in single precision.
SLACK = np.float32(2e-5)


class Best:
    """The ``k`` most similar distinct ids of each row so far, exactly; ids are numbered in their order."""

    def __init__(self, n: int, k: int):
        self.k, self.s, self.who = k, np.full((n, k), -1.0), np.full((n, k), -1, "i8")
        self.least = np.full(n, -np.inf, "f4")

    def seed(self, rows: np.ndarray, dots: np.ndarray, most: int) -> None:
        """Bounds from products with ``most`` or more others, among which are ``k`` other ids."""
        if dots.shape[1] >= most:
            bound = np.partition(dots, dots.shape[1] - most, axis=1)[:, dots.shape[1] - most] - SLACK
            self.least[rows] = np.maximum(self.least[rows], bound)

    def add(self, row: np.ndarray, who: np.ndarray, s: np.ndarray) -> None:
        hit = np.unique(row)
        row = np.concatenate([np.repeat(hit, self.k), row])
        who, s = np.concatenate([self.who[hit].ravel(), who]), np.concatenate([self.s[hit].ravel(), s])
        row, who, s = row[who >= 0], who[who >= 0], s[who >= 0]
        order = np.lexsort((-s, who, row))  # of equal ids the most similar
        row, who, s = row[order], who[order], s[order]
        first = np.r_[True, (row[1:] != row[:-1]) | (who[1:] != who[:-1])]
        row, who, s = row[first], who[first], s[first]
        order = np.lexsort((who, -s, row))
        row, who, s = row[order], who[order], s[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < self.k
        self.s[row[top], place[top]], self.who[row[top], place[top]] = s[top], who[top]
        full = hit[self.who[hit, -1] >= 0]
        self.least[full] = np.maximum(self.least[full], (1.5 - 0.5 / self.s[full, -1] - SLACK).astype("f4"))


def all_against_all(ids: np.ndarray, x: np.ndarray, left: np.ndarray, k: int, tile: tuple[int, int] = (1024, 4096), asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, other, similarity)``, each ``other`` a row too: up to ``k`` most similar ids of each row that ``asks`` (all by default) among rows of the other side.

    Rows are of the ``left`` side or not; with one side only, all rows meet. Products in single
    precision decide what is measured in double; none that may be among the ``k`` is passed over.
    """
    _, first, number, times = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
    most = (k + 1) * int(times.max())
    x, best = unit(x), Best(len(x), k)
    if asks is not None:
        best.least[~asks] = np.inf
    f = x.astype("f4")
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    one = not len(a) or not len(b)
    if one:
        a = b = np.arange(len(x))
    for s in range(0, len(a), tile[0]):
        rows = a[s : s + tile[0]]
        for t in range(s if one else 0, len(b), tile[1]):
            others = b[t : t + tile[1]]
            dots = f[rows] @ f[others].T
            for at, d in ((rows, dots), (others, dots.T)):
                if np.isneginf(best.least[at]).any():
                    best.seed(at, np.ascontiguousarray(d), most)
            near = (dots >= best.least[rows][:, None]) | (dots >= best.least[others])
            i, j = np.divmod(np.flatnonzero(near), len(others))
            i, j = rows[i], others[j]
            other = number[i] != number[j]
            i, j = i[other], j[other]
            for u in range(0, len(i), 1 << 16):
                p, q = i[u : u + (1 << 16)], j[u : u + (1 << 16)]
                exact = similarity(x[p], x[q])
                row, who, s2 = np.concatenate([p, q]), np.concatenate([number[q], number[p]]), np.concatenate([exact, exact])
                if asks is not None:
                    row, who, s2 = row[asks[row]], who[asks[row]], s2[asks[row]]
                if len(row):
                    best.add(row, who, s2)
    row, place = np.nonzero(best.who >= 0)
    return row, first[best.who[row, place]], best.s[row, place]


def nearest_of_all(vectors: DataFrame, k: int = 5, dim: int = 64, block: int = 65_536, done: DataFrame | None = None) -> DataFrame:
    """``(id, rank, neighbour, similarity)``: the ``k`` most similar ids of each, however far, by measuring all pairs.

    Ids and vectors as in ``nearest``, ids with many copies included; fewer than ``k`` rows only if there are
    no more other ids. Ids of ``done`` get no rows but are others' neighbours. Vectors are dealt to blocks of about ``block``; each pair of blocks is one task, so work is
    quadratic in the vectors, and each vector is sent once for each block. Two blocks without an asking vector don't meet.
    """
    n_blocks = max(1, -(-vectors.count() // block))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of exact copies within a task the ``k`` + 1 smallest ids; larger ones are nobody's neighbour, their own are in ``copies``."""
        kept: dict[bytes, list[str]] = {}
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            keep = np.ones(len(x), bool)
            for i, (name, body) in enumerate(zip(batch.column("id").to_pylist(), x)):
                smallest = kept.setdefault(xxhash.xxh128_digest(body.tobytes()), [])
                if name in smallest or (len(smallest) > k and name > smallest[-1]):
                    keep[i] = False
                else:
                    smallest.append(name)
                    smallest.sort()
                    del smallest[k + 1 :]
            yield batch.filter(pa.array(keep))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks() if (held := list(batches)) else []
        if len(rows) == 0 or not (asks := rows.column("asks").to_numpy()).any():
            return
        name, v, blocks = rows.column("id").combine_chunks(), rows.column("v").combine_chunks(), rows.column("block").to_numpy()
        row, other, s = all_against_all(np.array(name.to_pylist(), dtype=object), v.flatten().to_numpy().reshape(-1, dim), blocks == blocks.min(), k, asks=asks)
        for start in range(0, len(row), 65_536):
            part = slice(start, start + 65_536)
            yield pa.RecordBatch.from_arrays([name.take(pa.array(row[part])), name.take(pa.array(other[part])), pa.array(s[part])], names=["id", "neighbour", "similarity"])

    rows = _clean(vectors, dim).mapInArrow(few, "ref long, id string, v array<float>").withColumn("block", F.pmod("ref", F.lit(n_blocks)))
    late = copies(vectors, k, dim).drop("rank")
    if done is None:
        rows = rows.withColumn("asks", F.lit(True))
    else:
        rows = rows.join(done.select("id", F.lit(False).alias("no")), "id", "left").withColumn("asks", F.coalesce("no", F.lit(True)))
        late = late.join(done.select("id"), "id", "left_anti")
    every = F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")
    cell = lambda i, j: F.shiftright(F.greatest(i, j) * (F.greatest(i, j) + 1), 1) + F.least(i, j)
    dealt = rows.select("id", "v", "block", "asks", F.explode(F.transform(every, lambda j: cell(F.col("block"), j).cast("int"))).alias("cell"))
    found = dealt.repartitionById(n_blocks * (n_blocks + 1) // 2, "cell").drop("cell").mapInArrow(meet, "id string, neighbour string, similarity double")
    # one shuffle by id serves both the sum and the rank
    found = found.unionByName(late).repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "neighbour", "similarity")


def nearest_whole(vectors: DataFrame, k: int = 5, floor: float = 0.8, config: IndexConfig = IndexConfig(), dim: int = 64) -> DataFrame:
    """``(id, rank, neighbour, similarity)``: the ``k`` most similar ids of each usable id, near or far.

    The index gives those ids their neighbours for which it finds ``k`` at similarity ``floor`` or more;
    any other id is measured against all vectors in blocks, exactly. The index' rows are used twice, so they
    are written to the checkpoint folder first.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    near = nearest(vectors, k, floor, config, dim).checkpoint()
    done = near.where(F.col("rank") == k).select("id")
    return near.join(done, "id", "left_semi").unionByName(nearest_of_all(vectors, k, dim, done=done))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable id's neighbours, near or far, those of ids with many copies too."""
    return nearest_whole(table(spark, sf_dir, "vectors")).withColumn("similarity", F.round("similarity", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutual(nearest(table(spark, sf_dir, "vectors")))
