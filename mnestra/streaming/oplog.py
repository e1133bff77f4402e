"""Operation log as a stream: batches appended whole to a log keyed by seq, the state folded from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnestra.operators.store import fold_oplog
from mnestra.schema import OPLOG
from mnestra.sources.versioned import VersionedTable


def read_oplog(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New rows of a folder of parquet files, all of them: ts is out of step with seq, so none is too late.

    A seq delivered again stays in; the log of ``fold_stream`` keeps one row for each seq.
    """
    return spark.readStream.schema(OPLOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fold_stream(rows: DataFrame, log: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Append each batch to a versioned log keyed by seq: a batch that is tried again writes the same rows."""

    def add(batch: DataFrame, _: int) -> None:
        log.upsert(batch)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(log: VersionedTable) -> DataFrame:
    """The state after all operations read so far."""
    return fold_oplog(log.read())


def operations_per_window(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """``(window, op, n)`` counts of a stream or table by event time; equal rows count once."""
    return rows.groupBy(F.window(F.col("ts").cast("timestamp"), width), F.lower(F.trim("op")).alias("op")).agg(F.size(F.collect_set(F.struct(*rows.columns))).cast("long").alias("n"))
