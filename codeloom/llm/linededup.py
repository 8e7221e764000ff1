"""Reversible line dedup: exact reference counts, and cuckoo filters in front of them.

A line's key is the line without white space at its ends, in lower case (A-Z). The index counts, for each
key, the documents that hold it, and keeps the keys found in enough documents in cuckoo filters, one for each
shard of the keys. Inserting or deleting documents adds to or takes from the counts; keys that cross
the limit enter or leave their shard's filter, so deleting what was inserted gives back the
former index.

Lines are looked up in the filters, at any size. Filters within FILTER_BYTES (checked) go to the executors and
documents stay where they are; of larger ones each stays with its shard, and the keys of lines are shuffled to
their shard's filter. A shard whose keys occur in very many lines is dealt in parts, each with the filter. The few counted keys that
the filters take for frequent though the counts say they aren't are found in the same way; so the answer is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import HOT_KEYS, materialize, unused

WHITE = b" \t\n\x0b\x0c\r"
#: Lines with keys found in so many documents go.
LIMIT = 10
#: Shortest key in code points.
LEAST = 1
#: Keys in a shard's filter, and most bytes of all filters that are sent to executors.
SHARD_KEYS = 200_000
FILTER_BYTES = 64 << 20
#: Most keys that filters may take wrongly for frequent and that are sent to executors with them.
EXCEPTIONS = 100_000
#: About the keys of one part of a shard.
PART_KEYS = 1_000_000
KEYS_AT_ONCE = 200_000


def lines_and_keys(text: str | None, least: int = LEAST) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text, and for each its 128-bit key, b"" if it has none. Null is one empty line."""
    data = (text or "").encode("utf-8", "surrogatepass")
    keys = [line.strip(WHITE) for line in data.lower().split(b"\n")]
    digest = xxhash.xxh3_128_digest
    return data.split(b"\n"), [digest(k) if len(k) >= least and (least < 2 or len(k.decode("utf-8", "surrogatepass")) >= least) else b"" for k in keys]


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; a key lies in one of two buckets. Counts need no room
    here: each key is in at most once. Full filters grow and are filled anew by their owner."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int | None = None, data: bytes | None = None):
        self.table = np.zeros((buckets, self.SLOTS), np.uint32) if data is None else np.frombuffer(data, np.uint32).reshape(-1, self.SLOTS).copy()
        self.mask = len(self.table) - 1

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, math.ceil(math.log2(max(1, len(keys)) / cls.SLOTS / 0.8)))
        while True:
            own = cls(buckets)
            if all(own.insert(a, b) for a, b in keys.tolist()):
                return own
            buckets *= 2

    def _places(self, a: int, b: int) -> tuple[int, int, int]:
        mark = (b & 0xFFFFFFFF) or 1
        one = a & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995 >> 13) & self.mask)

    def insert(self, a: int, b: int) -> bool:
        mark, one, two = self._places(a, b)
        for place in (one, two):
            row = self.table[place]
            for slot in range(self.SLOTS):
                if not row[slot]:
                    row[slot] = mark
                    return True
        place = two
        for kick in range(self.KICKS):
            slot = (mark + kick) % self.SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = self._other(place, mark)
            row = self.table[place]
            for slot in range(self.SLOTS):
                if not row[slot]:
                    row[slot] = mark
                    return True
        return False

    def delete(self, a: int, b: int) -> bool:
        mark, one, two = self._places(a, b)
        for place in (one, two):
            for slot in range(self.SLOTS):
                if self.table[place, slot] == mark:
                    self.table[place, slot] = 0
                    return True
        return False

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (rows of two signed integers) the filter may hold; it misses none."""
        a, b = keys[:, 0].astype(np.uint64), keys[:, 1].astype(np.uint64) & np.uint64(0xFFFFFFFF)
        mark = np.where(b == 0, np.uint64(1), b)
        one = a & np.uint64(self.mask)
        two = one ^ ((mark * np.uint64(0x5BD1E995) >> np.uint64(13)) & np.uint64(self.mask))
        mark = mark.astype(np.uint32)[:, None]
        return (self.table[one.astype(np.int64)] == mark).any(1) | (self.table[two.astype(np.int64)] == mark).any(1)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 1] >> 33) % shards


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _counted(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        keys = _keys(list(found))
        batch = pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(found.values(), pa.int64())], names=["key_a", "key_b", "n"])
        found.clear()
        return batch

    for batch in batches:
        for text in batch.column("text"):
            found.update({k for k in lines_and_keys(text.as_py(), least)[1] if k})
            if len(found) >= KEYS_AT_ONCE:
                yield out()
    yield out()


def _updated(old: pd.DataFrame, crossed: pd.DataFrame) -> pd.DataFrame:
    shard = int((old if len(old) else crossed)["shard"].iloc[0])
    up, down = (crossed.loc[crossed["up"] == x, ["key_a", "key_b"]].to_numpy("int64") for x in (True, False))
    own = CuckooFilter(data=old["filter"].iloc[0]) if len(old) else CuckooFilter.of(up[:0])
    done = all([own.delete(a, b) for a, b in down.tolist()]) and all(own.insert(a, b) for a, b in up.tolist())
    n = (int(old["n"].iloc[0]) if len(old) else 0) + len(up) - len(down)
    return pd.DataFrame({"shard": [shard], "n": [n], "filter": [own.table.tobytes() if done else b""]})


@dataclass
class LineIndex:
    """refs: key_a, key_b, refs, written; filters: shard, n, filter, written."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    limit: int = LIMIT
    least: int = LEAST

    @classmethod
    def of(cls, docs: DataFrame, limit: int = LIMIT, least: int = LEAST) -> LineIndex:
        refs = materialize(_references(docs, least).select("key_a", "key_b", F.col("n").alias("refs")), "refs")
        return cls(refs, refs, 1, limit, least)._sharded()

    def _sharded(self) -> LineIndex:
        """Fills new filters from the counts, as many as keep each within SHARD_KEYS."""
        frequent = self.refs.where(F.col("refs") >= self.limit)
        self.shards = max(1, -(-frequent.count() // SHARD_KEYS))
        self.filters = materialize(_filters(self.refs, self.limit, self.shards), "filters")
        return self

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes out documents that were inserted before."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = _references(docs, self.least).select("key_a", "key_b", F.lit(0).cast("long").alias("old"), (F.lit(sign) * F.col("n")).alias("more"))
        merged = self.refs.select("key_a", "key_b", F.col("refs").alias("old"), F.lit(0).cast("long").alias("more")).union(delta)
        merged = materialize(merged.groupBy("key_a", "key_b").agg(F.sum("old").alias("old"), (F.sum("old") + F.sum("more")).alias("refs")), "refs")
        up = F.col("refs") >= self.limit
        crossed = merged.where(up != (F.col("old") >= self.limit)).select("key_a", "key_b", up.alias("up"), _shard(self.shards))
        rest = merged.where("refs > 0").select("key_a", "key_b", "refs")
        more = crossed.where("up").groupBy("shard").agg(F.count("*").alias("more")).join(self.filters.select("shard", "n"), "shard", "left")
        if not more.where(F.col("more") + F.coalesce("n", F.lit(0)) > 2 * SHARD_KEYS).isEmpty():  # a task would fill one filter with all of them
            return LineIndex(rest, rest, 1, self.limit, self.least)._sharded()
        new = self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_updated, "shard long, n long, filter binary")
        out = LineIndex(rest, materialize(new, "filters"), self.shards, self.limit, self.least)
        full = out.filters.where((F.length("filter") == 0) | (F.col("n") > 2 * SHARD_KEYS)).limit(1).count()
        return out._sharded() if full else out

    def dedup(self, docs: DataFrame, counts: bool = True) -> DataFrame:
        """docs with the lines of frequent keys taken out of text, and n_lines and n_dropped if counts is true.

        Other columns stay, whatever their names; with counts, n_lines and n_dropped of the input are replaced. The documents
        must have been inserted. Null and empty texts are one empty line and come out empty; lines without
        a key always stay; a document may lose all its lines and is then an empty text. Repeated rows stay repeated.
        """
        docs = _plain(docs, counts)
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size <= FILTER_BYTES:
            tables = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}  # within FILTER_BYTES
            send = docs.sparkSession.sparkContext.broadcast
            filters, shards = send(tables), self.shards
            wrong = self.refs.where(F.col("refs") < self.limit).select("key_a", "key_b").mapInArrow(lambda it: _taken(filters.value, shards, it), "key_a long, key_b long")
            wrong = wrong.limit(EXCEPTIONS + 1).collect()
            if len(wrong) <= EXCEPTIONS:
                not_frequent, least = send({np.array([tuple(r)], "<i8").tobytes() for r in wrong}), self.least
                return docs.mapInArrow(lambda it: _without(filters.value, shards, not_frequent.value, least, counts, it), _schema(docs, counts))
        return self.dedup_by_shard(docs, counts)

    def dedup_by_shard(self, docs: DataFrame, counts: bool = True) -> DataFrame:
        """The same for filters of any size: each line's key goes to its shard's filter, what the filter holds comes back to the text."""
        least, docs = self.least, _plain(docs, counts)
        one, two, listed, salts = unused(docs, "text_a", "text_b", "gone", "salts")
        named = docs.withColumn(one, F.xxhash64("text")).withColumn(two, F.xxhash64(F.lit(1), "text"))
        lines = named.select(F.col(one).alias("text_a"), F.col(two).alias("text_b"), "text").mapInArrow(lambda it: _listed(least, it), "text_a long, text_b long, key_a long, key_b long")
        sizes = self.refs.groupBy(_shard(self.shards)).agg(F.greatest(F.sum("refs"), F.count("*")).alias("n")).collect()  # one number for each filter
        parts = {r["shard"]: -(-r["n"] // PART_KEYS) for r in sizes}
        wrong = self._held(self.refs.where(F.col("refs") < self.limit).select(F.lit(0).cast("long").alias("text_a"), F.lit(0).cast("long").alias("text_b"), "key_a", "key_b"), parts, "key_a")
        held = self._held(lines, parts, "text_a").join(materialize(wrong.select("key_a", "key_b"), "wrong"), ["key_a", "key_b"], "left_anti")
        gone = held.groupBy(F.col("text_a").alias(one), F.col("text_b").alias(two)).agg(F.collect_set(F.struct("key_a", "key_b")).alias(listed))
        # rows of a text that very many share go to several tasks, and so does what is gone from it; few texts are as common
        (salt,) = unused(named, "salt")
        count = named.groupBy(one, two).agg(F.count("*").alias("n"))
        bound = docs.count() / HOT_KEYS
        hot = materialize(count.where(F.col("n") > bound).select(one, two, F.ceil(F.col("n") / max(1.0, bound)).cast("long").alias(salts)), "hot")
        dealt = named.join(F.broadcast(hot), [one, two], "left").withColumn(salt, F.coalesce(F.pmod(F.monotonically_increasing_id(), salts), F.lit(0))).drop(salts)
        gone = gone.join(F.broadcast(hot), [one, two], "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
        joined = dealt.join(gone, [one, two, salt], "left").select(*docs.columns, listed)
        return joined.mapInArrow(lambda it: _without_listed(least, listed, counts, it), _schema(docs, counts))

    def _held(self, rows: DataFrame, parts: dict[int, int], salt: str) -> DataFrame:
        """Those of the rows (text_a, text_b, key_a, key_b) whose key their shard's filter holds."""
        sent = rows.sparkSession.sparkContext.broadcast(parts)
        shards, names = self.shards, ["text_a", "text_b", "key_a", "key_b", "shard", "part"]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = shard_of(np.column_stack([batch.column(c).to_numpy() for c in ("key_a", "key_b")]), shards)
                of = np.array([sent.value.get(x, 1) for x in shard.tolist()], np.int64)
                part = batch.column(salt).to_numpy() % np.maximum(of, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(part)], names=names)

        routed = rows.mapInArrow(route, ", ".join(f"{c} long" for c in names))
        numbers = rows.sparkSession.createDataFrame(sorted(parts.items()) or [(0, 1)], "shard long, parts long")
        copies = self.filters.select("shard", "filter").join(numbers, "shard").select("shard", "filter", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
        return routed.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_passed, "text_a long, text_b long, key_a long, key_b long")


def _passed(lines: pa.Table, filters: pa.Table) -> pa.Table:
    names = ["text_a", "text_b", "key_a", "key_b"]
    if not lines.num_rows or not filters.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in names})
    own = CuckooFilter(data=filters.column("filter")[0].as_py())
    keys = np.column_stack([lines.column(c).to_numpy() for c in ("key_a", "key_b")])
    return lines.select(names).filter(pa.array(own.holds(keys)))


def _plain(docs: DataFrame, counts: bool) -> DataFrame:
    return (docs.drop("n_lines", "n_dropped") if counts else docs).withColumn("text", F.coalesce("text", F.lit("")))


def _schema(docs: DataFrame, counts: bool) -> T.StructType:
    return T.StructType([*docs.schema.fields, *([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if counts else [])])


def _references(docs: DataFrame, least: int) -> DataFrame:
    """key_a, key_b, n: the documents (rows) that hold a key; each task sends a key once or a few times."""
    return docs.select("text").mapInArrow(lambda it: _counted(least, it), "key_a long, key_b long, n long").groupBy("key_a", "key_b").agg(F.sum("n").alias("n"))


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("key_b", 33), F.lit(shards)).cast("long").alias("shard")


def _filters(refs: DataFrame, limit: int, shards: int) -> DataFrame:
    keys = refs.where(F.col("refs") >= limit).select(_shard(shards), "key_a", "key_b")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = CuckooFilter.of(rows[["key_a", "key_b"]].to_numpy("int64"))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "n": [len(rows)], "filter": [own.table.tobytes()]})

    return keys.groupBy("shard").applyInPandas(build, "shard long, n long, filter binary")


_open: dict[int, tuple[dict, dict[int, CuckooFilter]]] = {}


def _opened(tables: dict[int, bytes]) -> dict[int, CuckooFilter]:
    if (have := _open.get(id(tables))) is None or have[0] is not tables:
        _open.clear()
        have = _open[id(tables)] = (tables, {shard: CuckooFilter(data=data) for shard, data in tables.items()})
    return have[1]


def _positive(filters: dict[int, CuckooFilter], shards: int, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    of = shard_of(keys, shards)
    for shard in np.unique(of).tolist():
        if shard in filters:
            here = np.flatnonzero(of == shard)
            out[here] = filters[shard].holds(keys[here])
    return out


def _taken(tables: dict[int, bytes], shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters = _opened(tables)
    for batch in batches:
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(2)])
        yield batch.filter(pa.array(_positive(filters, shards, keys)))


def _rewritten(batch: pa.RecordBatch, texts: list, lines: list, dropped: list, counts: bool) -> pa.RecordBatch:
    i = next(i for i, name in enumerate(batch.schema.names) if name.lower() == "text")
    batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, pa.string()))
    if not counts:
        return batch
    return batch.append_column("n_lines", pa.array(lines, pa.int64())).append_column("n_dropped", pa.array(dropped, pa.int64()))


def _without(tables: dict[int, bytes], shards: int, not_frequent: set[bytes], least: int, counts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters = _opened(tables)
    for batch in batches:
        split = [lines_and_keys(text.as_py(), least) for text in batch.column("text")]
        keys = [k for _, own in split for k in own if k]
        hot = iter(_positive(filters, shards, _keys(keys)).tolist())
        texts, n, dropped = [], [], []
        for lines, own in split:
            keep = [not (k and next(hot) and k not in not_frequent) for k in own]
            texts.append(b"\n".join(line for line, stays in zip(lines, keep) if stays).decode("utf-8", "surrogatepass"))
            n.append(len(lines))
            dropped.append(len(lines) - sum(keep))
        yield _rewritten(batch, texts, n, dropped, counts)


def _listed(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each text, once; a text that comes again in a batch is left out."""
    for batch in batches:
        seen = set()
        for a, b, text in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), batch.column("text")):
            if (a, b) in seen:
                continue
            seen.add((a, b))
            keys = _keys(list({k for k in lines_and_keys(text.as_py(), least)[1] if k}))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), x, np.int64)) for x in (a, b)] + [pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["text_a", "text_b", "key_a", "key_b"])


def _without_listed(least: int, listed: str, counts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n, dropped = [], [], []
        for text, found in zip(batch.column("text"), batch.column(listed).to_pylist()):
            lines, own = lines_and_keys(text.as_py(), least)
            gone = {np.array([(d["key_a"], d["key_b"])], "<i8").tobytes() for d in found or ()}
            keep = [k not in gone for k in own]
            texts.append(b"\n".join(line for line, stays in zip(lines, keep) if stays).decode("utf-8", "surrogatepass"))
            n.append(len(lines))
            dropped.append(len(lines) - sum(keep))
        yield _rewritten(batch.select([c for c in batch.schema.names if c != listed]), texts, n, dropped, counts)


def deduplicate_lines(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, counts: bool = True) -> DataFrame:
    """docs without the lines whose keys occur in at least limit of these documents; see dedup()."""
    return LineIndex.of(docs, limit, least).dedup(docs, counts)
