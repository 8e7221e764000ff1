"""Approximate nearest neighbours: vectors in the cells of a coarse codebook, of which a query reads only some.

The codebook is learned by k-means on a bounded sample; every vector of its width is put in the cell of its nearest centre, so all stay
reachable. How many cells a query must look into is learned too: as many as hold the wanted share of the true neighbours in
the sample. Vectors in these cells are compared exactly, as the flat index does, which stays the default.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.functions import vectors as V
from codeloom.functions.tables import unused
from codeloom.operators import index

#: Most vectors that the codebook is learned from, and most of its cells.
SAMPLE, CELLS = 20_000, 4096
#: Rounds of k-means; queries that tell how many cells to look into, and the share of their neighbours that must lie there.
ROUNDS, TRIALS, WANTED = 12, 400, 0.97
#: Most vectors and queries that meet in a task.
ROWS, QUERIES = 50_000, 5_000


class Codebook(NamedTuple):
    centres: np.ndarray
    probes: int


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)[None, :]


def nearest_cells(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each point, the nearest first; ties go to the smaller number."""
    if n == 1:
        return _distances(points, centres).argmin(1)[:, None]
    return np.argsort(_distances(points, centres), axis=1, kind="stable")[:, :n]


def learned(points: np.ndarray, cells: int, k: int, wanted: float = WANTED, seed: int = 1) -> Codebook:
    """A codebook of at most so many cells, from a sample."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[: max(1, cells)]]
    for _ in range(ROUNDS):
        of = np.concatenate([nearest_cells(points[i : i + 4096], centres, 1)[:, 0] for i in range(0, len(points), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, of, points)
        n = np.bincount(of, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    of = np.concatenate([nearest_cells(points[i : i + 4096], centres, 1)[:, 0] for i in range(0, len(points), 4096)])
    asked = rng.permutation(len(points))[:TRIALS]
    deep = []  # where in a query's order of cells its neighbours lie
    for i in asked.tolist():
        near = np.argsort(_distances(points[i : i + 1], points)[0], kind="stable")[:k]
        place = np.empty(len(centres), np.int64)
        place[nearest_cells(points[i : i + 1], centres, len(centres))[0]] = np.arange(len(centres))
        deep += place[of[near]].tolist()
    return Codebook(centres, int(np.quantile(deep, wanted, method="higher")) + 1)


def learn(vectors: DataFrame, k: int = 10, *, key: str = "unit_id", vector: str = "vector", cells: int | None = None, sample: int = SAMPLE, wanted: float = WANTED) -> Codebook:
    """From at most about sample vectors, drawn by a hash of the key, of the most common width; as many cells as the root of
    the number of vectors, CELLS at most."""
    sized = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"), F.size(vector).alias("width"))
    widths = sized.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not widths:
        return Codebook(np.zeros((0, 0)), 0)
    n = widths[0]["n"]
    drawn = sized.where((F.col("width") == widths[0]["width"]) & (F.pmod(F.xxhash64(F.lit("cells"), "key"), F.lit(1 << 40)) < int(min(1.0, sample / n) * (1 << 40))))
    points = np.array([r["v"] for r in drawn.orderBy("key").select("v").collect()], np.float64)
    if not len(points):  # the draw may be empty if keys are all alike
        points = np.array([r["v"] for r in sized.where(F.col("width") == widths[0]["width"]).limit(sample).select("v").collect()], np.float64)
    return learned(points, cells or min(CELLS, max(1, int(n**0.5))), k, wanted)


def assigned(vectors: DataFrame, codebook: Codebook, *, vector: str = "vector", n: int = 1, cell: str = "cell") -> DataFrame:
    """A row for each vector and each of its n nearest cells; vectors of another width have none and are left out."""
    sent, width = vectors.sparkSession.sparkContext.broadcast(codebook.centres), codebook.centres.shape[1]
    rows = vectors.drop(cell).where(F.size(F.coalesce(vector, F.array())) == width) if width else vectors.drop(cell).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                points = part.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                found = nearest_cells(points, sent.value, n)
                yield part.take(pa.array(np.repeat(np.arange(part.num_rows), found.shape[1]))).append_column(cell, pa.array(found.ravel().astype(np.int32)))

    return rows.mapInArrow(run, rows.withColumn(cell, F.lit(0)).schema)


def write_cells(vectors: DataFrame, codebook: Codebook, path: str, *, key: str = "unit_id", vector: str = "vector") -> None:
    """An index in the folders of its cells, hot ones in several files."""
    rows = assigned(vectors.select(key, vector), codebook, vector=vector)
    rows.repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("cell").parquet(path)


def knn(cells: DataFrame, codebook: Codebook, query: Sequence[float], k: int = 10, *, key: str = "unit_id", vector: str = "vector", probes: int | None = None) -> DataFrame:
    """As index.knn(), among the vectors of the cells that are nearest to the query; of a written index only their folders are read."""
    if not codebook.probes or len(query) != codebook.centres.shape[1]:
        return index.knn(cells.limit(0), query, k, key=key, vector=vector)
    near = nearest_cells(np.array([query], np.float64), codebook.centres, probes or codebook.probes)[0].tolist()
    return index.knn(cells.where(F.col("cell").isin(near)), query, k, key=key, vector=vector)


def knn_batch(cells: DataFrame, codebook: Codebook, queries: DataFrame, k: int = 10, *, key: str = "unit_id", vector: str = "vector", query_key: str = "query_id", query_vector: str = "query_vector", probes: int | None = None) -> DataFrame:
    """As index.knn_batch(), each query among the vectors of the cells that are nearest to it.

    The vectors of a cell, and the queries that look into it, are cut into blocks of at most about ROWS and QUERIES by a hash of their keys;
    each pair of blocks meets in a task, which keeps k for each query. So a cell that holds a third of all vectors is many tasks.
    """
    schema = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {cells.schema[key].dataType.simpleString()}, d2 double"
    if not codebook.probes:
        return cells.sparkSession.createDataFrame([], schema + ", score double, rank int")
    asked = assigned(queries.select(F.col(query_key).alias("q"), F.col(query_vector).alias("v")), codebook, vector="v", n=probes or codebook.probes)
    data = cells.select(F.col(key), F.col(vector), "cell")
    counts = lambda rows, name, most: rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = counts(data, "wide", ROWS).join(counts(asked, "tall", QUERIES), "cell")  # one row for each cell, CELLS at most
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at_i, at_j, wide, tall = unused(data, "i", "j", "wide", "tall")
    sizes = F.broadcast(sizes.toDF("cell", wide, tall))
    left = asked.join(sizes, "cell").select("q", "v", "cell", block("q", tall).alias(at_i), every(wide).alias(at_j))
    right = data.join(sizes, "cell").select(key, vector, "cell", block(key, wide).alias(at_j), every(tall).alias(at_i))
    query_kind, key_kind = to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(cells.schema[key].dataType)

    def met(own: pa.Table, points: pa.Table) -> pa.Table:
        out = pa.schema([(query_key, query_kind), (key, key_kind), ("d2", pa.float64())])
        if not own.num_rows or not points.num_rows:
            return out.empty_table()
        these = own.column("q").combine_chunks(), np.array(own.column("v").to_pylist(), np.float64)
        near = list(index._nearest(these, k, query_key, key, points.select([key, vector]).to_batches()))
        return pa.Table.from_batches(near).cast(out) if near else out.empty_table()

    found = left.groupBy("cell", at_i, at_j).cogroup(right.groupBy("cell", at_i, at_j)).applyInArrow(met, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy("d2", key))).where(F.col("rank") <= k)
    return ranked.select(query_key, key, "d2", V.similarity("d2").alias("score"), "rank")


def recall(found: DataFrame, exact: DataFrame, *, key: str = "unit_id", query_key: str = "query_id") -> DataFrame:
    """query_key, recall: the share of the exact neighbours that were found."""
    hit = exact.select(query_key, key).join(found.select(query_key, key).withColumn("hit", F.lit(1)), [query_key, key], "left")
    return hit.groupBy(query_key).agg((F.count("hit") / F.count("*")).alias("recall"))
