"""Build of an index: list, parse, embed what is new, write a version, report.

A version's tables lie in one folder of the store: listing, units, audit, file_meta, embedded and vectors. The repository is
listed once, and all else is made from that table, so a file that changes meanwhile is new to the next build. A version becomes
visible, with what it adds to the cache, by one commit after all its tables are written; see store.py.

Contents are held once in a version, in units. What is parsed is written beside it until units are numbered, and then dropped.
"""

from __future__ import annotations

import datetime
import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.functions import paths as P
from codeloom.functions import tables
from codeloom.operators import cache as C
from codeloom.operators import catalog as K
from codeloom.operators import embed, incremental, index, metrics, report, units
from codeloom.plans.store import Store, added
from codeloom.sources import git, repository


#: What is needed of units, and of files that failed, to put units in order and to tell how files fared.
FOUND = ["rel_path", "pos", "unit_type", "error", "error_type"]


@dataclass
class Built:
    location: str
    index_name: str
    units: DataFrame
    vectors: DataFrame
    audit: DataFrame
    report: dict = field(default_factory=dict)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The files with the reason why a file is skipped."""
    return repository.listing(spark, root).withColumn("skip_reason", repository.skip_reason("extension", "ignored"))


def summary(spark: SparkSession, root: str, *, erlang_too: bool = False) -> dict:
    """What an index would hold: the report of a dry run. Writes nothing."""
    files = scan(spark, root).cache()
    parsed = units.parse(files.where("skip_reason is null"), erlang_too=erlang_too).cache()
    now = datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    out = report.document(root, now, {}, units.audit(files, parsed), repository.folders(spark, root), units.numbered(parsed))
    parsed.unpersist()
    files.unpersist()
    return out


def _base(versions: DataFrame, root: str) -> list:
    """The version that an incremental build goes on from: of the checked-out commit or the nearest ancestor that has one, the
    newest; without such a version the newest of all. One row, or none."""
    rows = K.newest_first(versions).collect()  # of one repository
    behind = {c: git.behind(root, c) for c in {r["commit"] for r in rows} if c}
    near = [r for r in rows if behind.get(r["commit"]) is not None]
    return sorted(near, key=lambda r: behind[r["commit"]])[:1] or rows[:1]


def build_index(spark: SparkSession, root: str, store: str, embedder: embed.Embedder | None = None, *, incremental_build: bool = False, erlang_too: bool = False, with_report: bool = True) -> Built:
    """Builds a version of the index of a repository. An incremental build parses only files that are new
    or changed since the newest version of the repository; its result equals that of a full build."""
    began = {"start": time.time()}
    root = root.rstrip("/") or "/"
    place, embedder = Store(spark, store), embedder or embed.HashingEmbedder()
    commit, dirty = git.version(root)
    name = spark.range(1).select(P.safe_name(F.lit(os.path.basename(os.path.abspath(root)))).alias("name"), P.path_hash(F.lit(root)).alias("hash")).first()
    version = f"{commit}-latest" if commit and dirty else commit or "flat"
    location = f"{place.path}/versions/{name['name']}.{name['hash']}/{version}-{uuid.uuid4().hex}"

    def written(table: DataFrame, part: str) -> DataFrame:
        table.write.option("compression", "zstd").parquet(f"{location}/{part}")
        return spark.read.parquet(f"{location}/{part}")

    listed = written(repository.walked(spark, root), "listing")
    files = repository.files(listed).withColumn("skip_reason", repository.skip_reason("extension", "ignored"))
    eligible = files.where("skip_reason is null")
    file_meta = written(eligible.select("rel_path", "mtime", "size"), "file_meta")
    previous = _base(place.catalog().where((F.col("repo_name") == name["name"]) & (F.col("path_hash") == name["hash"]) & (F.col("model") == embedder.model) & (F.col("dimensions") == embedder.dimensions)), root) if incremental_build else []
    fresh = eligible
    if previous:
        changed = tables.materialize(incremental.changes(file_meta, spark.read.schema(schemas.FILE_META).parquet(f"{previous[0]['location']}/file_meta")), "changed")
        fresh = eligible.join(changed.where("change in ('new', 'modified')").select("rel_path"), "rel_path", "left_semi")
    parsed = tables.bucketed(units.parse(fresh, erlang_too=erlang_too), f"{location}/parsed", "rel_path")
    found = parsed.select(*FOUND)
    if previous:
        old, failed = (spark.read.parquet(f"{previous[0]['location']}/{part}") for part in ("units", "audit"))
        old = old.select(F.col("path").alias("rel_path"), F.col("seq").alias("pos"), "content", "unit_type", "name", "package", "class_name")
        failed = failed.where("error_type is not null").select("rel_path", F.lit(None).alias("pos"), F.lit(None).alias("unit_type"), "error", "error_type")
        same = incremental.kept_units(old.drop("content").withColumns({c: F.lit(None).cast("string") for c in ("error", "error_type")}).select(*FOUND).unionByName(failed), changed, unit_key="rel_path")
        same = tables.materialize(same, "kept")
        found = found.unionByName(same)
    seen = metrics.Seen()
    start = units.starts(units.counted(found))
    own = units.numbered(parsed, start)
    if previous:
        own = own.unionByName(units.numbered(tables.chosen(old, "pos", same.where("pos is not null")), start))
    own = written(seen.units(own), "units")
    audit = written(seen.files(units.audit(files, found)), "audit")
    place.drop(f"{location}/parsed")
    tables.release(spark)
    began["parsed"] = time.time()

    # what is cached now stays as it is here, whatever other builds add or merge meanwhile
    base = place.deltas()
    mine = (F.col("model") == embedder.model) & (F.col("dimensions") == embedder.dimensions)
    cached = place.entries(base, own.select("content_hash")).where(mine)
    new = written(embed.embed_units(own, embedder, cached), "embedded")
    good = new.where("vector is not null").select(*schemas.names(schemas.CACHE))
    delta = place.write_delta(good)
    began["embedded"] = time.time()

    vectors = written(index.build_vectors(own, cached.unionByName(good), embedder.dimensions), "vectors")
    n = own.count()
    failed = own.join(new.where("vector is null").select("content_hash"), "content_hash", "left_semi").count()
    if vectors.count() + failed != n:
        raise RuntimeError(f"{n} units, but {vectors.count()} vectors and {failed} failures; the version is not added")
    index_name = f"{name['name']}.{name['hash']}/{version}"
    now = int(datetime.datetime.now(datetime.timezone.utc).timestamp() * 1_000_000)

    def make(number: int) -> list[dict]:
        entries = place.entries([*place.deltas(number - 1), delta._replace(turn=number)]).select(*C.KEY).count()
        row = (index_name, name["name"], name["hash"], commit, dirty, root, now, n, embedder.dimensions, bool(previous), embedder.model, location, place.commit_file(number), entries)
        info = json.dumps(dict(zip(schemas.names(schemas.CATALOG), row)))
        return [added(delta, number), {"action": "add", "kind": "version", "path": location, "turn": number, "rows": n, "info": info}]

    place.commit(make)
    place.compact()
    tables.release(spark)
    began["indexed"] = time.time()

    out = Built(location, index_name, own, vectors, audit)
    if with_report:
        names = list(began)
        timings = {b: began[b] - began[a] for a, b in zip(names, names[1:])} | {"total": time.time() - began["start"]}
        out.report = report.document(root, datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S"), timings, audit, repository.pruned(listed), own, seen)
        for suffix, body in (("json", report.as_json(out.report)), ("html", report.as_html(out.report))):
            spark.createDataFrame([(body,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{location}/report_{suffix}")
    return out


def list_indexes(spark: SparkSession, store: str) -> DataFrame:
    """The newest row of each index name, newest first."""
    latest = Store(spark, store).catalog().groupBy("index_name").agg(F.max_by(F.struct(*schemas.names(schemas.CATALOG)), "indexed_on").alias("r")).select("r.*")
    return K.newest_first(latest)


def write_index_list(spark: SparkSession, store: str) -> str:
    """A text file with one index name in a line, newest first, for other tools; nothing here reads it."""
    names = list_indexes(spark, store).select(F.concat("index_name", F.lit("\t"), F.col("indexed_on").cast("string")).alias("value"))
    names.coalesce(1).write.mode("overwrite").text(f"{store.rstrip('/')}/indexes")
    return f"{store.rstrip('/')}/indexes"
