"""Query history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = 10


def latest(history: DataFrame, keep: int = KEEP, *, query: str = "query", ts: str = "ts") -> DataFrame:
    """The latest time of each query, newest first; ties by query."""
    return history.where(F.col(query).isNotNull()).groupBy(query).agg(F.max(ts).alias(ts)).orderBy(F.col(ts).desc(), query).limit(keep)


def matching(history: DataFrame, part: str, *, query: str = "query") -> DataFrame:
    """Queries that hold a text, in either case."""
    return history.where(F.contains(F.lower(query), F.lit(part.lower())))


def record(history: DataFrame, new: DataFrame, keep: int = KEEP) -> DataFrame:
    """The history with new queries in front of it."""
    return latest(history.unionByName(new), keep)
