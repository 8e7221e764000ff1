"""Embedding cache: a table keyed by content hash, model and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.tables import chosen, unused

KEY = ["content_hash", "model", "dimensions"]


def lookup(units: DataFrame, cache: DataFrame) -> DataFrame:
    """units with hit: whether their content hash is cached."""
    known = cache.select("content_hash").distinct().withColumn("hit", F.lit(True))
    return units.join(known, "content_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(units: DataFrame, cache: DataFrame) -> DataFrame:
    """One content for each hash that isn't cached, the one that comes first. seq is unique. Hashes alone are joined and grouped;
    contents stay where they are, so units should be a written table."""
    new = units.select("content_hash", "seq").join(cache.select("content_hash"), "content_hash", "left_anti")
    return chosen(units.select("content_hash", "content", "seq"), "seq", new.groupBy("content_hash").agg(F.min("seq").alias("seq"))).drop("seq")


def hit_counts(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def merge(*caches: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Union of caches in which a later one wins."""
    key = key or [c for c in KEY if c in caches[0].columns]
    turn, row = unused(caches[0], "turn", "row")
    every = None
    for i, cache in enumerate(caches):
        part = cache.withColumn(turn, F.lit(i))
        every = part if every is None else every.unionByName(part)
    rest = [c for c in caches[0].columns if c not in key]
    return every.groupBy(*key).agg(F.max_by(F.struct(*rest), turn).alias(row)).select(*key, f"{row}.*").select(*caches[0].columns)


def distinct_contents(units: DataFrame) -> DataFrame:
    """content_hash, first_seq, copies of each content."""
    return units.groupBy("content_hash").agg(F.min("seq").alias("first_seq"), F.count("*").alias("copies"))


def identity_dedup(units: DataFrame, identity: list[str], *, order: str = "seq") -> DataFrame:
    """The first row of each identity, by order. Nulls are equal. Combines before it shuffles."""
    rest = [c for c in units.columns if c not in identity]
    (row,) = unused(units, "row")
    first = units.groupBy(*identity).agg(F.min_by(F.struct(*rest), order).alias(row))
    return first.select(*identity, f"{row}.*").select(*units.columns)
