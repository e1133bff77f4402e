"""Readers for the parquet tables a data directory holds, and the shared folder for what is written between steps."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, a file or a folder of files, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, or its checkpoint folder. Without either one is set in local mode only; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    return os.path.join(tempfile.gettempdir(), "mnestra-checkpoints")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """See that ``checkpoint`` has a folder: the session's own, else ``shared_folder``."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def trimmed(col: Column) -> Column:
    """``col`` without outer U+0020; null for a null or blank value."""
    return F.nullif(F.trim(col), F.lit(""))


def reference_key(col: Column) -> Column:
    """Ids are compared without outer blanks and without regard to case; null and blank are no id."""
    return F.lower(trimmed(col))
