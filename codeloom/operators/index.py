"""Flat vector index: exact nearest neighbours by squared L2 distance.

One query is a literal in a projection, and the top k a sort that keeps k rows for each partition.
Many queries are sent to the vectors, or, if they are more than fit, both are cut into blocks that meet in the cells of a
grid; a task or a cell keeps k neighbours for each query before anything more is shuffled. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.functions import vectors as V

#: Most bytes of query vectors that go to every task or are in a block, and bytes of a block of vectors.
QUERY_BYTES, VECTOR_BYTES = 32 << 20, 128 << 20
#: Vectors that a task compares at a time, and distances that it holds meanwhile.
ROWS = 2048
DISTANCES = 1 << 18


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10, *, key: str = "unit_id", vector: str = "vector") -> DataFrame:
    """key, d2, score, rank of the k nearest. Reads only the key and the vectors; skips null vectors."""
    if not k or not len(query):
        return vectors.select(key, F.lit(0.0).alias("d2"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    near = vectors.select(key, V.squared_l2(vector, V.literal(query)).alias("d2")).where("d2 is not null")
    top = near.orderBy("d2", key).limit(k)
    return top.select(key, "d2", V.similarity("d2").alias("score"), F.row_number().over(Window.orderBy("d2", key)).alias("rank"))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "unit_id", vector: str = "vector", query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query key, key, d2, score, rank: k nearest of each query, of those vectors that are as long as the queries, which must be of
    one length.

    Queries of at most QUERY_BYTES (checked) go to all tasks, which compare them with a batch of vectors at a time and keep
    k of each. More queries are cut into blocks of that size, vectors into blocks of VECTOR_BYTES, and each pair of
    blocks is a cell that does the same; so no block passes through the driver.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(query_vector).alias("v"))
    data = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    schema = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, d2 double"
    n, width, least = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.min(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema + ", score double, rank int")
    if least != width:
        raise ValueError(f"queries of {least} to {width} numbers; ask for those of each length")
    if n * width * 8 <= QUERY_BYTES:
        rows = asked.collect()
        sent = spark.sparkContext.broadcast((pa.array([r["q"] for r in rows], to_arrow_type(queries.schema[query_key].dataType)), np.array([r["v"] for r in rows], np.float64)))
        found = data.mapInArrow(lambda it: _nearest(sent.value, k, query_key, key, it), schema)
    else:
        tall, wide = -(-n * width * 8 // QUERY_BYTES), max(1, -(-data.count() * width * 8 // VECTOR_BYTES))
        block = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
        every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
        left = asked.select("q", "v", block("q", tall).alias("i"), every(wide).alias("j"))
        right = data.select(F.col(key), F.col(vector), block(key, wide).alias("j"), every(tall).alias("i"))

        def cell(own: pa.Table, points: pa.Table) -> pa.Table:
            empty = pa.schema([(query_key, own.schema.field("q").type), (key, points.schema.field(key).type), ("d2", pa.float64())])
            if not own.num_rows:
                return empty.empty_table()
            these = own.column("q").combine_chunks(), pc.list_flatten(own.column("v").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, -1)
            near = list(_nearest(these, k, query_key, key, points.select([key, vector]).to_batches()))
            return pa.Table.from_batches(near).cast(empty) if near else empty.empty_table()

        found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy("d2", key))).where(F.col("rank") <= k)
    return ranked.select(query_key, key, "d2", V.similarity("d2").alias("score"), "rank")


def _nearest(asked: tuple[pa.Array, np.ndarray], k: int, query_key: str, key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k nearest vectors of the partition for each query."""
    ids, queries = asked
    width = queries.shape[1]
    step = ROWS
    most = max(1, DISTANCES // step)
    best_d = np.empty((len(ids), 0))
    best_k: np.ndarray | None = None
    kind = None
    for batch in batches:
        lists = batch.column(1)
        same = np.flatnonzero(lists.value_lengths().to_numpy(zero_copy_only=False) == width)
        if not len(same):
            continue
        take = batch.take(pa.array(same))
        kind = take.schema.field(0).type
        points = take.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        keys = take.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(points), step):
            here = points[at : at + step]
            held = min(k, best_d.shape[1] + len(here))
            next_d, next_k = np.empty((len(ids), held)), np.empty((len(ids), held), keys.dtype)
            for first in range(0, len(ids), most):  # so many queries at a time, however many there are
                own = slice(first, first + most)
                d = np.stack([np.square(here - q).sum(axis=1) for q in queries[own]])
                all_d = np.concatenate([best_d[own], d], axis=1)
                new = np.broadcast_to(keys[at : at + step], d.shape)
                all_k = new if best_k is None else np.concatenate([best_k[own], new], axis=1)
                order = np.lexsort((all_k, all_d), axis=1)[:, :k]
                next_d[own], next_k[own] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_k, order, 1)
            best_d, best_k = next_d, next_k
    if best_k is not None:
        n = best_d.shape[1]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), n))), pa.array(best_k.ravel(), kind), pa.array(best_d.ravel())], names=[query_key, key, "d2"])


def with_units(hits: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """The units of the hits. Spark knows from a limit how few the hits are, and sends them to the units if so."""
    return units.join(hits, key)


def build_vectors(units: DataFrame, embedded: DataFrame, dimensions: int) -> DataFrame:
    """unit_id, vector of the units whose content was embedded; failures aren't indexed."""
    good = embedded.where("vector is not null").select("content_hash", V.resize("vector", dimensions).alias("vector"))
    return units.select("unit_id", "content_hash").join(good, "content_hash").select("unit_id", "vector")
