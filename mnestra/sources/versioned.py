"""Keyed tables on immutable files: appended versions, of which the newest of a key counts."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    """``<path>/v=<number>``: each folder holds rows or tombstones of one write.

    A write is one new folder, so readers never see half of it once it is named; a failed one leaves
    no finished folder. ``compact`` writes the current rows as one version and removes the older
    folders from the oldest on, so that a row goes before its tombstone. Compacted rows keep the
    number of the write they came by, and tombstones stay for ``_GRACE`` seconds, so a write that was
    under way and ends after the compaction is neither hidden by older rows nor brings deleted ones back.
    """

    _GRACE = 86_400

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str]):
        self.spark, self.path, self.key = spark, path, list(key)
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path, jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path, make = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v=(\d+)", n)) and fs.exists(make(f"{self.path}/{n}/_SUCCESS")))

    def _newest(self, found: list[int], keys: DataFrame | None = None) -> DataFrame:
        """The newest row or tombstone of each key in the given versions; of ``keys`` only, where these are given: few, so they are sent to the rows."""
        stored = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_at", T.LongType()), T.StructField("v", T.LongType())])
        rows = self.spark.read.schema(stored).option("basePath", self.path).parquet(*[f"{self.path}/v={n}" for n in found])
        if keys is not None:
            rows = rows.join(F.broadcast(keys.select(*self.key)), self.key, "left_semi")
        rows = rows.withColumn("_at", F.coalesce("_at", "v"))
        return rows.withColumn("_k", F.row_number().over(W.partitionBy(*self.key).orderBy(F.desc("_at")))).where("_k = 1").drop("_k")

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """Current rows, of a bounded number of ``keys`` if given; an empty table if nothing was written."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self._newest(found, keys).where("NOT _gone").select(*self.schema.names)

    def changes(self, after: int) -> tuple[DataFrame, DataFrame, int]:
        """Rows written and keys removed by versions later than ``after``, and the newest version's number; only these versions are read."""
        found = [n for n in self.versions() if n > after]
        if not found:
            empty = self.spark.createDataFrame([], self.schema)
            return empty, empty.select(*self.key), after
        newest = self._newest(found)
        return newest.where("NOT _gone").select(*self.schema.names), newest.where("_gone").select(*self.key), found[-1]

    def written(self, version: int) -> DataFrame:
        """The rows of one write, tombstones left out."""
        stored = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType())])
        return self.spark.read.schema(stored).parquet(f"{self.path}/v={version}").where("NOT _gone").select(*self.schema.names)

    def _write(self, rows: DataFrame, gone: bool) -> int:
        version = max([time.time_ns(), *(n + 1 for n in self.versions()[-1:])])
        have = set(rows.columns)
        shaped = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(gone).alias("_gone"))
        shaped.write.parquet(f"{self.path}/v={version}")
        return version

    def upsert(self, rows: DataFrame) -> int:
        return self._write(rows, False)

    def delete(self, keys: DataFrame) -> int:
        """Remove rows by their key columns; unknown keys do no harm."""
        return self._write(keys.select(*self.key), True)

    def compact(self) -> int:
        old = self.versions()
        if not old:
            return self._write(self.read(), False)
        version = max(time.time_ns(), old[-1] + 1)
        kept = self._newest(old).where(~F.col("_gone") | (F.col("_at") > F.lit(version - self._GRACE * 10**9)))
        kept.drop("v").write.parquet(f"{self.path}/v={version}")
        fs, _, make = self._fs()
        for n in old:
            fs.delete(make(f"{self.path}/v={n}"), True)
        return version

    def drop(self) -> None:
        fs, path, _ = self._fs()
        fs.delete(path, True)
