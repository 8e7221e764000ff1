"""Ranked lexical search as dense matrix products.

Only the items' terms count, so documents are read once for these: how often each occurs, and how many terms there are
in all. From this table tasks take documents in tiles: a dense matrix of impacts, documents by a tile of the
items' compact vocabulary, times a dense matrix of weights, vocabulary by a tile of items. Impacts and weights are integers
in float64; a vocabulary tile ends where its products could add up to 2**53, so every partial sum is exact whatever
order BLAS adds in, and tiles are added up as 64-bit integers. A task keeps k documents of each item, ties by id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

#: Hits of each item.
TOP = 10
#: Most items, and about the most bytes of their texts, that are searched for at a time.
ITEMS, ITEM_BYTES = 1024, 2 << 20
#: Documents, terms and items in a tile.
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 512, 2048, 256
#: No impact is as high: tf * 10**9 div (1000 * tf + 8 * m), where m is 25 at least.
IMPACT = 1_000_000
#: Most of the weights that one item may have in a vocabulary tile: products then add up to less than 2**53.
TILE_WEIGHT = (2**53 - 1) // IMPACT
#: Bytes of a text that are cut into terms at a time.
SLICE = 4 << 20
#: Tasks whose hits meet before all of an item's do.
TASKS_AT_ONCE = 256

#: A term is a run of digits, letters and characters above U+007F: in UTF-8, of these bytes.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice; only A-Z are lower-cased."""
    data, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0
    while at < len(data):
        cut = BETWEEN.search(data, at + SLICE) if at + SLICE < len(data) else None
        end = cut.start() if cut else len(data)
        yield TERM.findall(data, at, end)
        at = end


def counted(text: str | None) -> Counter[bytes]:
    found: Counter[bytes] = Counter()
    for some in terms(text):
        found.update(some)
    return found


class Asked(NamedTuple):
    """A block of items: how often each has each term of their vocabulary."""

    item_ids: list
    vocabulary: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def asked(rows: list) -> Asked:
    """From collected items (item_id, text)."""
    vocabulary: dict[bytes, int] = {}
    item, term, times = [], [], []
    for i, row in enumerate(rows):
        for word, n in counted(row["text"]).items():
            item.append(i)
            term.append(vocabulary.setdefault(word, len(vocabulary)))
            times.append(n)
    return Asked([r["item_id"] for r in rows], vocabulary, np.array(item, np.int64), np.array(term, np.int64), np.array(times, np.int64))


POSTINGS = "doc_id long, n long, term array<int>, tf array<long>"


def _posted(vocabulary: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, term, tf = [], [], []
        for text in batch.column("text"):
            found = counted(text.as_py())
            n.append(sum(found.values()))
            own = [(t, times) for word, times in found.items() if (t := vocabulary.get(word)) is not None]
            term.append([t for t, _ in own])
            tf.append([times for _, times in own])
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])
        yield out.filter(pa.array(np.array(n) > 0))


class Weights(NamedTuple):
    """Columns of the vocabulary tiles. The weight of an item for a term may be dealt to several columns."""

    n_items: int
    tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # terms of the columns; item, column, weight of the entries


def weights(block: Asked, n_docs: int, df: dict[int, int]) -> Weights:
    """Weight tiles of a block: entries of at most TILE_WEIGHT, columns in tiles of at most TILE_TERMS and, for every item,
    TILE_WEIGHT."""
    one = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    by_term: dict[int, list[tuple[int, int]]] = {}
    for i, t, times in zip(block.item.tolist(), block.term.tolist(), block.times.tolist()):
        if one.get(t, 0) > 0:
            by_term.setdefault(t, []).append((i, times * one[t]))
    tiles, columns, entries, most = [], [], [], 0

    def end() -> None:
        if columns:
            i, c, w = np.array(entries, np.int64).T
            tiles.append((np.array(columns, np.int64), i, c, w))

    for t in sorted(by_term):
        left = by_term[t]
        while left:
            part = max(min(w, TILE_WEIGHT) for _, w in left)
            if columns and (most + part > TILE_WEIGHT or len(columns) == TILE_TERMS):
                end()
                columns, entries, most = [], [], 0
            entries += [(i, len(columns), min(w, TILE_WEIGHT)) for i, w in left]
            columns.append(t)
            most += part
            left = [(i, w - TILE_WEIGHT) for i, w in left if w > TILE_WEIGHT]
    end()
    return Weights(len(block.item_ids), tiles)


def scores(own: Weights, width: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """items x documents, 64-bit integers. row, term, impact: the non-zero impacts of a tile of documents; width: all terms."""
    total = np.zeros((own.n_items, n_docs), np.int64)
    order = np.argsort(term, kind="stable")
    row, term, impact = row[order], term[order], impact[order]
    for columns, item, column, weight in own.tiles:
        places = np.full(width, -1)
        places[columns] = np.arange(len(columns))  # of several columns for a term the last; the others follow below
        low, high = np.searchsorted(term, columns[0], "left"), np.searchsorted(term, columns[-1], "right")
        at = places[term[low:high]]
        dense = np.zeros((len(columns), n_docs))
        dense[at[at >= 0], row[low:high][at >= 0]] = impact[low:high][at >= 0]
        dense = dense[places[columns]]
        for first in range(0, own.n_items, TILE_ITEMS):
            here = (item >= first) & (item < first + TILE_ITEMS)
            if here.any():
                tall = np.zeros((min(TILE_ITEMS, own.n_items - first), len(columns)))
                tall[item[here] - first, column[here]] = weight[here]
                total[first : first + len(tall)] += (tall @ dense).astype(np.int64)
    return total


class Best:
    """The k best documents of each item so far: highest score, then smallest id, a null id last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * n_items

    def add(self, ids: np.ndarray, null: np.ndarray, table: np.ndarray) -> None:
        for i, row in enumerate(table):
            score, doc, none = self.held[i]
            least = score[-1] if len(score) == self.k else 1
            if len(row) > self.k:  # all that tie with the k-th best stay until ids decide
                least = max(least, np.partition(row, -self.k)[-self.k])
            new = np.flatnonzero(row >= least)
            if len(new):
                score, doc, none = np.concatenate([score, row[new]]), np.concatenate([doc, ids[new]]), np.concatenate([none, null[new]])
                order = np.lexsort((doc, none, -score))[: self.k]
                self.held[i] = score[order], doc[order], none[order]


HITS = "item int, doc_id long, score long"


def _searched(own: Weights, width: int, n_docs: int, n_terms: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = Best(own.n_items, k)
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_DOCS):
            part = batch.slice(at, TILE_DOCS)
            n = part.column("n").to_numpy()
            sizes = part.column("term").value_lengths().to_numpy()
            row, tf = np.repeat(np.arange(len(n)), sizes), part.column("tf").flatten().to_numpy()
            # 75 * n * N is beyond 64 bits for the longest texts of the largest corpora
            m = np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            ids = part.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            best.add(ids.fill_null(0).to_numpy(), null, scores(own, width, row, part.column("term").flatten().to_numpy(), impact, len(n)))
    for i, (score, doc, none) in enumerate(best.held):
        if len(score):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int32()), pa.array(doc, mask=none), pa.array(score)], names=["item", "doc_id", "score"])


def _ranked_block(docs: DataFrame, block: Asked, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(block.vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posted = materialize(rows.mapInArrow(lambda it: _posted(vocabulary.value, it), POSTINGS), "postings")
    n_docs, n_terms = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["df"] for r in posted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    own, width = spark.sparkContext.broadcast(weights(block, n_docs, df)), len(block.vocabulary)
    hits = posted.mapInArrow(lambda it: _searched(own.value, width, n_docs, n_terms, k, it), HITS).withColumn("some", F.expr(f"spark_partition_id() div {TASKS_AT_ONCE}"))
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    few = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item", "some").orderBy(*by))).where(F.col("rank") <= k)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(block.item_ids)), "item int, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def blocks(items: DataFrame) -> list[DataFrame]:
    """The items in blocks of at most about ITEMS rows and ITEM_BYTES of text (or of one item)."""
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    fit = lambda n, size: n <= 1 or (n <= ITEMS and size <= ITEM_BYTES)
    n, size = sized.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if fit(n, size):
        return [sized] if n else []
    sized = materialize(sized, "items")
    parts = 2 * max(-(-n // ITEMS), -(-size // ITEM_BYTES))
    while True:
        block = F.pmod(F.xxhash64("row"), F.lit(parts))
        found = sized.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
        if found.where((F.col("n") > 1) & ((F.col("n") > ITEMS) | (F.col("size") > ITEM_BYTES))).isEmpty():
            return [sized.where(block == i) for i in range(parts)]
        parts *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item.

    Every row of items is asked for, also if several have one id, and every row of docs is a document. Equal scores are
    ranked by doc_id, a null one last. Null and empty texts have no terms: such items have no hits, such documents are none and
    aren't counted. Tables without rows give none. Items are taken in blocks of bounded size, and documents are read
    once for each block; a block's vocabulary and weights go to all tasks.
    """
    out = None
    for part in blocks(items):
        rows = part.orderBy("row").collect()  # bounded by ITEMS and ITEM_BYTES
        if rows:
            found = _ranked_block(docs, asked(rows), k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
