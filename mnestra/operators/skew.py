"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot; there can't be more hot keys than that.
HOT_SHARE = 1000


def hot_keys(rows: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than 1 in ``share`` of the rows: fewer than ``share``. Counts are combined before their shuffle; null is no key."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") * share > rows.agg(F.count("*").alias("n")).scalar()).select(key)


def join_unique(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows to a side that has each key at most once.

    Rows of hot keys stay where they are: of ``unique`` only the hot keys' rows, fewer than 1,000,
    are broadcast to them. All others are merged by a shuffle that no hot key crowds.
    """
    hot = F.broadcast(hot_keys(rows, key))
    crowded = rows.join(hot, key, "left_semi").join(F.broadcast(unique.join(hot, key, "left_semi")), key)
    return crowded.unionByName(rows.join(hot, key, "left_anti").hint("merge").join(unique, key))
