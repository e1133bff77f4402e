"""A stored inverted index: postings in buckets of terms, kept up by generations.

A generation is a folder with the postings of the rows that changed, the rows themselves without
their text, and one row of statistics of the whole index, which is written last and makes it
count. A search reads the buckets of its terms only, and no text. Postings of a row that a later
generation has again are passed over; ``compact`` writes one generation and removes the others.
"""

from __future__ import annotations

import re
import time

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.operators import fts

#: Occurrences a bucket holds on average, and the bounds of the number of buckets.
BUCKET_TERMS, FEWEST, MOST = 2_000_000, 8, 4096
#: Occurrences of a bucket from which its rows are dealt over several files; a term in every row is split with it.
FILE_TERMS = 8_000_000

#: Statistics of finished generations by folder, which never change.
_TOTALS: dict[str, dict] = {}

_POSTINGS = "term string, id string, content_at array<int>, tags_at array<int>, length int, archived boolean, insert_seq bigint, g bigint, bucket int"


class TextIndex:
    """The index in a folder all executors reach. Rows are ``(id, content, tags, archived, insert_seq)``, an id once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- generations ----------------------------------------------------------------------
    def _fs(self):
        jvm = self.spark._jvm
        make = jvm.org.apache.hadoop.fs.Path
        return make(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def generations(self) -> list[int]:
        """Numbers of the finished generations, oldest first; those before a compacted one don't count."""
        fs, make = self._fs()
        if not fs.exists(make(self.path)):
            return []
        found = []
        for s in fs.listStatus(make(self.path)):
            name = s.getPath().getName()
            if (m := re.fullmatch(r"([gc])=(\d+)", name)) and fs.exists(make(f"{self.path}/{name}/total/_SUCCESS")):
                found.append((int(m[2]), m[1]))
        found.sort()
        whole = max((i for i, (_, kind) in enumerate(found) if kind == "c"), default=0)
        self._names = {n: f"{self.path}/{kind}={n}" for n, kind in found}
        return [n for n, _ in found[whole:]]

    def total(self, generation: int) -> dict:
        """``n``, ``terms``, ``buckets`` and ``source`` of the index as of a generation."""
        folder = self._names[generation]
        if folder not in _TOTALS:
            _TOTALS[folder] = self.spark.read.parquet(f"{folder}/total").first().asDict()
        return _TOTALS[folder]

    @property
    def source(self) -> int:
        """The number of the newest state of the source that the index has; -1 for an empty one."""
        known = self.generations()
        return self.total(known[-1])["source"] if known else -1

    def _docs(self, known: list[int]) -> DataFrame:
        shape = "id string, length int, archived boolean, insert_seq bigint, gone boolean, g bigint"
        if not known:
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).parquet(*[f"{self._names[g]}/docs" for g in known])
        if len(known) == 1:
            return rows.where("NOT gone")
        return rows.groupBy("id").agg(F.max_by(F.struct("length", "archived", "insert_seq", "gone", "g"), "g").alias("d")).select("id", "d.*").where("NOT gone")

    # -- writes ---------------------------------------------------------------------------
    def refresh(self, changed: DataFrame, removed: DataFrame | None = None, source: int = 0, kind: str = "g") -> int:
        """Take in new and changed rows and leave out ``removed`` ids; an unchanged row may come again. The generation's number."""
        known = [] if kind == "c" else self.generations()
        at = self.total(known[-1]) if known else None
        number = max([time.time_ns(), *(g + 1 for g in known[-1:])])
        folder = f"{self.path}/{kind}={number}"
        cut = fts.indexed(changed)
        length = (F.size("content_terms") + F.size("tag_terms")).alias("length")
        docs = cut.select("id", length, "archived", "insert_seq", F.lit(False).alias("gone"))
        if removed is not None:
            docs = docs.unionByName(removed.select("id").join(docs.select("id"), "id", "left_anti").select("id", F.lit(0).alias("length"), F.lit(False).alias("archived"), F.lit(0).cast("bigint").alias("insert_seq"), F.lit(True).alias("gone")))
        docs.withColumn("g", F.lit(number)).write.parquet(f"{folder}/docs")
        own = self.spark.read.parquet(f"{folder}/docs").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("terms"), F.count("*").alias("n")).first()
        buckets = at["buckets"] if at else min(MOST, max(FEWEST, 1 << (int(own["terms"]) // BUCKET_TERMS).bit_length()))
        files = 1 + int(own["terms"]) // buckets // FILE_TERMS
        arms = [cut.select("id", "archived", "insert_seq", length, F.lit(c).alias("arm"), F.posexplode(f"{c}_terms").alias("at", "term")) for c in ("content", "tag")]
        places = lambda c: F.sort_array(F.collect_list(F.when(F.col("arm") == c, F.col("at") + 1)))
        found = arms[0].unionByName(arms[1]).groupBy("id", "term").agg(places("content").alias("content_at"), places("tag").alias("tags_at"), *[F.first(c).alias(c) for c in ("length", "archived", "insert_seq")])
        dealt = found.select("term", "id", "content_at", "tags_at", "length", "archived", "insert_seq", F.lit(number).alias("g"), self._bucket(F.col("term"), buckets).alias("bucket"))
        dealt.repartition(buckets * files, "bucket", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
        self._names = (self._names if known else {}) | {number: folder}
        state = self._docs([*known, number]).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("terms")) if known else None
        row = (own["n"], int(own["terms"])) if state is None and removed is None else tuple((state or self._docs([number]).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("terms"))).first())
        self.spark.createDataFrame([(*row, buckets, source)], "n long, terms long, buckets int, source long").coalesce(1).write.parquet(f"{folder}/total")
        return number

    def compact(self, current: DataFrame, source: int = 0) -> int:
        """The index anew from all current rows; older generations are removed once the new one counts."""
        old = self.generations()
        names = [self._names[g] for g in old]
        number = self.refresh(current, source=source, kind="c")
        fs, make = self._fs()
        for name in names:
            fs.delete(make(name), True)
        return number

    # -- reads ----------------------------------------------------------------------------
    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    @staticmethod
    def _bucket_of(word: str, buckets: int) -> int:
        """``_bucket`` of a word at hand: the same hash and seed."""
        code = xxhash.xxh64_intdigest(word.encode(), 42)
        return (code - (1 << 64) if code >= 1 << 63 else code) % buckets

    def postings(self, words: list[tuple[str, bool]] | None = None, known: list[int] | None = None) -> DataFrame:
        """``(term, id, content_at, tags_at, length, archived, insert_seq)`` of the given words, a prefix where marked; of all without.

        Exact words name their buckets, which prunes folders, and sorted terms prune row groups; a prefix prunes row groups of all buckets.
        """
        known = self.generations() if known is None else known
        if not known:
            return self.spark.createDataFrame([], _POSTINGS).drop("g", "bucket")
        rows = None
        for g in known:
            part = self.spark.read.schema(_POSTINGS).option("basePath", f"{self._names[g]}/postings").parquet(f"{self._names[g]}/postings")
            rows = part if rows is None else rows.unionByName(part)
        if words is not None:
            exact = sorted({w for w, prefix in words if not prefix})
            hit = F.col("term").isin(*exact) if exact else F.lit(False)
            for p in sorted({w for w, prefix in words if prefix}):
                hit = hit | F.col("term").startswith(p)
            rows = rows.where(hit)
            if not any(prefix for _, prefix in words):
                buckets = self.total(known[-1])["buckets"]
                rows = rows.where(F.col("bucket").isin(*sorted({self._bucket_of(w, buckets) for w in exact}))) if exact else rows
        if len(known) > 1:  # what a later generation has again, or has removed
            later = self.spark.read.parquet(*[f"{self._names[g]}/docs" for g in known[1:]]).groupBy("id").agg(F.max("g").alias("newest"))
            rows = rows.join(later, "id", "left").where("newest IS NULL OR g >= newest")
        return rows.select("term", "id", "content_at", "tags_at", "length", "archived", "insert_seq")

    def search(self, query: str, limit: int | None = 20, digits: int = 6) -> DataFrame:
        """``(rank, id, score)`` as ``fts.search`` gives it, from the postings of the query's words.

        Of one word nothing is shuffled but the best; several are put together by id.
        """
        known = self.generations()
        try:
            parsed = fts.parse_query(query)
        except fts.QuerySyntaxError:
            parsed = None
        if parsed is None or not known or not parsed.phrases:
            return self.spark.createDataFrame([], "rank int, id string, score double" if limit is not None else "id string, score double")
        words = list(dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in parsed.phrases for i, w in enumerate(p.words)))
        rows = self.postings(words, known)
        named = {}
        if len(words) == 1 and not words[0][1]:
            docs = rows.withColumnsRenamed({"content_at": "c0", "tags_at": "t0"})
            named[words[0]] = 0
        else:
            collected = []
            for k, (w, prefix) in enumerate(words):
                named[w, prefix] = k
                hit = F.col("term").startswith(w) if prefix else F.col("term") == w
                collected += [F.array_sort(F.flatten(F.collect_list(F.when(hit, F.col(f"{side}_at"))))).alias(f"{short}{k}") for side, short in (("content", "c"), ("tags", "t"))]
            docs = rows.groupBy("id").agg(*collected, *[F.first(c).alias(c) for c in ("length", "archived", "insert_seq")])
        docs = docs.withColumns(fts.placed(parsed, named)).select("id", "length", "archived", "insert_seq", *[f"{c}{i}" for i in range(len(parsed.phrases)) for c in ("any", "tf")])
        total = self.total(known[-1])
        return fts.best(docs, parsed, F.lit(total["n"]), F.lit(total["terms"] / max(total["n"], 1)), limit, digits)
