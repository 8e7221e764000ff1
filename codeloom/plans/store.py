"""The store of indexes: tables that are only ever added to, and a log of numbered commits that says which of them count.

Layout: commits/<number>.json (actions, one in a line), cache/delta=<name> (deltas of the embedding cache, in folders by bucket
of the content hash) and versions/<repository>/<version>-<name> (the tables of one index version). A writer first writes its tables
under new names, then makes the commit with the next number, which exists only once; if another writer was first, it takes the
number after that. So a commit is seen whole or not at all, and what two writers add at a time is all kept.

The log is read as a table. The store as it was at any commit is what has been added up to there and not removed.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.operators import cache as C

ACTIONS = "action string, kind string, path string, turn long, rows long, at double, info string"
#: Rows of a delta beside its partition, the bucket: gone is a tombstone.
DELTA = f"{schemas.CACHE}, gone boolean"
BUCKETS = 16
#: So many deltas of a size that follow each other are merged; sizes differ by this factor, and the smallest end here.
FANOUT, SMALL = 4, 10_000
#: Times that a writer looks for the next number.
ATTEMPTS = 1000


class Conflict(Exception):
    """What a commit was based on has been changed by another one."""


class Delta(NamedTuple):
    path: str
    turn: int
    rows: int


def bucket(content_hash: Column | str) -> Column:
    return F.pmod(F.xxhash64(content_hash), F.lit(BUCKETS)).cast("int")


def tier(rows: int) -> int:
    """Sizes of deltas, for merging."""
    return 0 if rows < SMALL else 1 + int(math.log(rows / SMALL, FANOUT))


class Store:
    """Folders of the store, by way of Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # folders

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        at, fs = self._folder(path)
        return fs.exists(at)

    def _entries(self, path: str) -> list[tuple[str, float]]:
        """Name and time of each entry."""
        at, fs = self._folder(path)
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)) if fs.exists(at) else []

    def drop(self, path: str) -> None:
        at, fs = self._folder(path)
        fs.delete(at, True)

    # the log

    def head(self) -> int:
        """The number of the last commit, -1 if there is none."""
        return max((int(name[:-5]) for name, _ in self._entries(f"{self.path}/commits") if name.endswith(".json") and name[:-5].isdigit()), default=-1)

    def commit_file(self, number: int) -> str:
        """A version's cache_ref: the commit whose cache it was built with."""
        return f"{self.path}/commits/{number:020d}.json"

    def _made(self, path: str, body: str) -> bool:
        """Makes a file with this body; False if it exists. The file appears with its whole body, or not at all."""
        folder, name = path.rsplit("/", 1)
        own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        at, fs = self._folder(own)
        out = fs.create(at, False)
        out.write(body.encode())
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename would replace a file here, a link doesn't
                os.link(at.toUri().getPath(), self._folder(path)[0].toUri().getPath())
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(at, self._folder(path)[0], self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            if self.exists(path):
                return False
            raise
        finally:
            fs.delete(at, False)
        return True

    def commit(self, make: Callable[[int], list[dict]]) -> int:
        """Adds a commit and gives its number. make(number): its actions, asked for again with the next number if another writer
        was first; it raises Conflict if what the actions rest on has changed."""
        for _ in range(ATTEMPTS):
            number = self.head() + 1
            body = "".join(json.dumps({"at": time.time()} | action) + "\n" for action in make(number))
            if self._made(self.commit_file(number), body):
                return number
        raise Conflict(f"no number was free in {ATTEMPTS} attempts")

    def actions(self, at: int | None = None) -> DataFrame:
        """All actions up to a commit, with its number."""
        path = f"{self.path}/commits"
        if self.head() < 0:
            return self.spark.createDataFrame([], f"{ACTIONS}, number long")
        rows = self.spark.read.schema(ACTIONS).json(path).withColumn("number", F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long"))
        return rows if at is None else rows.where(F.col("number") <= at)

    def live(self, kind: str, at: int | None = None) -> DataFrame:
        """path, turn, rows, at, info, number of what has been added up to a commit and not removed."""
        last = self.actions(at).where(F.col("kind") == kind).groupBy("path").agg(F.max_by(F.struct("action", "turn", "rows", "at", "info", "number"), "number").alias("r"))
        return last.select("path", "r.*").where("action = 'add'").drop("action")

    # index versions

    def catalog(self) -> DataFrame:
        rows = self.live("version").select(F.from_json("info", f"{schemas.CATALOG.replace('indexed_on timestamp', 'indexed_on long')}").alias("r")).select("r.*")
        return rows.withColumn("indexed_on", F.timestamp_micros("indexed_on")).select(*schemas.names(schemas.CATALOG))

    def drop_versions(self, locations: list[str]) -> None:
        """Takes versions out of the catalog; vacuum() deletes their tables."""
        self.commit(lambda number: [{"action": "remove", "kind": "version", "path": path} for path in locations])

    # the cache

    def deltas(self, at: int | None = None) -> list[Delta]:
        """The deltas that count at a commit, the oldest first: some for each size, as the rest has been merged."""
        return sorted((Delta(r["path"], r["turn"], r["rows"]) for r in self.live("cache", at).select("path", "turn", "rows").collect()), key=lambda d: d.turn)

    def write_delta(self, rows: DataFrame) -> Delta:
        """Writes rows (of the cache, or with gone) under a new name; they count once a commit adds them. turn isn't known yet."""
        path = f"{self.path}/cache/delta={uuid.uuid4().hex}"
        if "gone" not in rows.columns:
            rows = rows.withColumn("gone", F.lit(False))
        rows = rows.select(*schemas.names(DELTA), bucket("content_hash").alias("bucket"))
        rows.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "content_hash").sortWithinPartitions("bucket", "content_hash").write.partitionBy("bucket").parquet(path)
        return Delta(path, -1, self._read([path]).count() if any(name.startswith("bucket=") for name, _ in self._entries(path)) else 0)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{DELTA}, delta string, bucket int").option("basePath", f"{self.path}/cache").parquet(*paths)

    def entries(self, deltas: list[Delta], keys: DataFrame | None = None, *, tombstones: bool = False) -> DataFrame:
        """The rows that these deltas make: of each key the one of the latest delta, unless it is gone.

        keys: content_hash of those asked for; only their buckets are read. tombstones: keys that are gone stay as rows, with gone.
        """
        columns = schemas.names(DELTA if tombstones else schemas.CACHE)
        deltas = [d for d in deltas if d.rows]
        if not deltas:
            return self.spark.createDataFrame([], DELTA if tombstones else schemas.CACHE)
        turns = F.create_map(*[F.lit(x) for d in deltas for x in (d.path.rsplit("delta=", 1)[1], d.turn)])
        rows = self._read([d.path for d in deltas]).withColumn("turn", F.element_at(turns, F.col("delta")))
        if keys is not None:
            asked = [r[0] for r in keys.select(bucket("content_hash").alias("bucket")).distinct().collect()]  # BUCKETS at most
            rows = rows.where(F.col("bucket").isin(asked)).join(keys.select("content_hash").distinct(), "content_hash", "left_semi")
        if len(deltas) > 1:
            rows = rows.groupBy(*C.KEY).agg(F.max_by(F.struct("vector", "gone"), "turn").alias("r")).select(*C.KEY, "r.*")
        return (rows if tombstones else rows.where("not gone")).select(*columns)

    def cache(self, at: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The cache as it is, or was at a commit."""
        return self.entries(self.deltas(at), keys)

    def forget(self, keys: DataFrame) -> int:
        """Takes keys (content_hash, model, dimensions) out of the cache, by tombstones."""
        gone = self.write_delta(keys.select(*C.KEY).distinct().withColumn("vector", F.lit(None).cast("array<float>")).withColumn("gone", F.lit(True)))
        return self.commit(lambda number: [added(gone, number)])

    def compact(self) -> int | None:
        """Merges the newest run of deltas of one size that follow each other, if it is long enough; the commit's number.

        Each row is written again once for each size that it passes, so what builds write is in proportion to what is new.
        """
        deltas = self.deltas()
        run = next((deltas[i:j] for i, j in runs([tier(d.rows) for d in deltas]) if j - i >= FANOUT), None)
        if run is None:
            return None
        oldest = run[0] == deltas[0]  # what is gone may then be forgotten
        merged = self.write_delta(self.entries(run, tombstones=True).where("not gone") if oldest else self.entries(run, tombstones=True))

        def make(number: int) -> list[dict]:
            if not set(run) <= set(self.deltas()):
                raise Conflict("another writer has merged these")
            return [{"action": "remove", "kind": "cache", "path": d.path} for d in run] + [added(merged, run[-1].turn)]

        try:
            return self.commit(make)
        except Conflict:
            self.drop(merged.path)
            return None

    # what nobody needs

    def vacuum(self, older_than: float = 86_400) -> list[str]:
        """Deletes the tables of removed versions, merged deltas and folders that no commit names, all if older than so many
        seconds. A delta that counts at the commit which a version in the catalog names stays."""
        limit, log = time.time() - older_than, self.actions().select("action", "kind", "path", "number", "at").collect()
        pinned = [int(r["cache_ref"].rsplit("/", 1)[1][:-5]) for r in self.catalog().select("cache_ref").distinct().collect()]
        known: dict[str, list] = {}
        for r in sorted(log, key=lambda r: r["number"]):
            known.setdefault(r["path"], []).append(r)
        gone = []
        for path, history in known.items():
            last = history[-1]
            if last["action"] == "remove" and last["at"] < limit and not (last["kind"] == "cache" and any(history[0]["number"] <= n < last["number"] for n in pinned)):
                gone.append(path)
        folders = [(f"{self.path}/cache/{name}", at) for name, at in self._entries(f"{self.path}/cache")]
        for repository, _ in self._entries(f"{self.path}/versions"):
            folders += [(f"{self.path}/versions/{repository}/{name}", at) for name, at in self._entries(f"{self.path}/versions/{repository}")]
        there = {path for path, _ in folders}
        gone = [path for path in gone if path in there] + [path for path, at in folders if path not in known and at < limit]
        for path in gone:
            self.drop(path)
        return gone


def added(delta: Delta, turn: int) -> dict:
    return {"action": "add", "kind": "cache", "path": delta.path, "turn": turn, "rows": delta.rows}


def runs(values: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values, the last first."""
    end = len(values)
    while end:
        start = end
        while start and values[start - 1] == values[end - 1]:
            start -= 1
        yield start, end
        end = start

