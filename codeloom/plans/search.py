"""Search of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as T
from codeloom.operators import embed, index
from codeloom.plans import build


class SearchEngine:
    """An embedder and an index."""

    def __init__(self, embedder: embed.Embedder, units: DataFrame, vectors: DataFrame):
        self.embedder, self.units, self.vectors = embedder, units, vectors

    def search(self, query: str, top_k: int = 10, where: Column | str | None = None) -> DataFrame:
        """Units with d2, score and rank. where, a condition on units, holds before the nearest are chosen."""
        if not query:
            raise ValueError("a query is needed")
        vectors = self.vectors
        if where is not None:
            vectors = vectors.join(self.units.where(where).select("unit_id"), "unit_id", "left_semi")
        hits = index.knn(vectors, self.embedder.embed_query(query), top_k)
        return index.with_units(hits, self.units).orderBy("rank")


    def search_all(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """The same for rows query_id, query: units with query_id, d2, score and rank. Queries that can't be embedded have none."""
        hashed = queries.select("query_id", F.md5("query").alias("content_hash"), F.col("query").alias("content"))
        embedded = self.embedder.embed(hashed.groupBy("content_hash").agg(F.first("content").alias("content"))).select("content_hash", F.col("vector").alias("query_vector"))
        asked = hashed.select("query_id", "content_hash").join(embedded, "content_hash").drop("content_hash")
        return index.with_units(index.knn_batch(self.vectors, asked, top_k), self.units)


def open_index(spark: SparkSession, store: str, index_name: str | None = None, embedder: embed.Embedder | None = None) -> SearchEngine:
    """The named index, or the newest. A hashing embedder is made as the index says; others are passed in."""
    rows = build.list_indexes(spark, store)
    found = (rows if index_name is None else rows.where(F.col("index_name") == index_name)).limit(1).collect()
    if not found:
        raise LookupError(f"no index {index_name or ''} in {store}")
    row = found[0]
    embedder = embedder or embed.HashingEmbedder(row["dimensions"])
    if (embedder.model, embedder.dimensions) != (row["model"], row["dimensions"]):
        raise ValueError(f"the index was built with {row['model']}")
    return SearchEngine(embedder, spark.read.parquet(f"{row['location']}/units"), spark.read.parquet(f"{row['location']}/vectors"))


def search(spark: SparkSession, store: str, query: str, top_k: int = 10, index_name: str | None = None, embedder: embed.Embedder | None = None) -> DataFrame:
    return open_index(spark, store, index_name, embedder).search(query, top_k)


def json_rows(results: DataFrame) -> DataFrame:
    """Results as a service returns them: content cut at 1,000 characters, and the highlighter's language."""
    return results.select("path", "unit_type", "name", "package", "class_name", F.substring("content", 1, T.PREVIEW_JSON).alias("content"), "score", P.highlight_language("path").alias("language"))


def console_lines(results: DataFrame) -> DataFrame:
    """One text for each result."""
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n   {title}: "), c)).otherwise(F.lit(""))
    head = F.format_string("%d. %s (score %.2f)\n   %s %s", "rank", "path", "score", "unit_type", "name")
    return results.select("rank", F.concat(head, part("package", "package"), part("class", "class_name"), F.lit("\n"), T.preview("content")).alias("line")).orderBy("rank")
