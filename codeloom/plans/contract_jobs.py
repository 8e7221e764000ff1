"""More queries over the test tables: embedding with refusals, builds of several versions, streams, cells, and their SQL."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import tables
from codeloom.functions import text as T
from codeloom.functions import vectors as V
from codeloom.operators import batching, catalog, cells, embed, history, incremental, index, report, units
from codeloom.plans import build, search, store
from codeloom.plans import contract as C
from codeloom.sources import repository
from codeloom.streaming import files

#: What the client of embed_ladder takes in one call, in characters, and what it refuses in any text.
MOST_CHARS = 15_000
REFUSED = ("ñ", "@", "token")


class Picky:
    """A client that answers or refuses by content alone, and is busy whenever it meets a text of some lengths for the first time."""

    def __init__(self):
        self.met: set[str] = set()

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        for text in texts:
            if len(text) % 11 == 0 and text not in self.met:
                self.met.add(text)
                raise embed.Busy("try again", after=0.001)
        if sum(map(len, texts)) > MOST_CHARS:
            raise ValueError("max_tokens")
        if any(mark in text for text in texts for mark in REFUSED):
            raise ValueError("$.input")
        return [[float(len(text)), float(text.count("e"))] for text in texts]


def embed_ladder(spark, sf_dir):
    """How each document's prepared text fares with a client that refuses some: its chunk, the step that helped, the calls for
    the chunk, and what was sent at last."""
    embedder = embed.RemoteEmbedder(Picky, "picky", 2, embed.Calls(in_flight=3, retries=110))
    found = embedder.answers(C._table(spark, sf_dir, "documents"), "doc_id", T.prepare("text"))
    return found.select("doc_id", "batch", "chunk", "status", F.col("asked").cast("long").alias("asked"), F.col("vector")[0].cast("long").alias("sent"), F.col("vector")[1].cast("long").alias("e"))


def _ladder_sql() -> str:
    bad = lambda t: "(" + " OR ".join(f"contains({t}, '{mark}')" for mark in REFUSED) + ")"
    alone = lambda t: f"(length({t}) <= {MOST_CHARS} AND NOT {bad(t)})"
    extreme = "trim(regexp_replace(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\s\\p{{Z}}]', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
    return f"""
        WITH p AS (SELECT id AS doc_id, text AS t0, {C.TOKENS_SQL.format(t="text")} AS tokens, row_number() OVER (ORDER BY id) - 1 AS pos FROM ({C._prepared_sql("SELECT doc_id AS id, text FROM documents")})),
        b AS (SELECT *, pos // {batching.BATCH} AS batch FROM p), s AS (SELECT *, sum(tokens) OVER (PARTITION BY batch)::BIGINT AS total, count(*) OVER (PARTITION BY batch) AS n FROM b),
        c AS (SELECT *, (pos % {batching.BATCH}) // (CASE WHEN total > {batching.TOKENS_PER_BATCH} THEN greatest(1, n // (total // {batching.TOKENS_PER_BATCH} * 2 + 1)) ELSE n END) AS chunk FROM s),
        v AS (SELECT *, sum(tokens) OVER (PARTITION BY batch, chunk) > {T.TOKENS_PER_TEXT} AS single, {C.ASCII_SQL.format(t="t0")} AS a, {extreme.format(t="t0")} AS x FROM c),
        w AS (SELECT *, CASE WHEN {C.BLANK_SQL.format(t="a")} THEN '{T.EMPTY}' ELSE a END AS t1, CASE WHEN x = '' THEN '{T.PLACEHOLDER}' ELSE x END AS t2 FROM v),
        y AS (SELECT *, CASE WHEN {alone("t0")} THEN 1 WHEN {alone("t1")} THEN 2 ELSE 3 END AS steps, sum(length(t0)) OVER k > {MOST_CHARS} AS long0, sum(length(t1)) OVER k > {MOST_CHARS} AS long1,
            bool_or({bad("t0")}) OVER k AS bad0, bool_or({bad("t1")}) OVER k AS bad1 FROM w WINDOW k AS (PARTITION BY batch, chunk)),
        z AS (SELECT *, CASE WHEN single THEN 'alone' WHEN NOT long0 AND NOT bad0 THEN 'ok' WHEN NOT long0 AND NOT long1 AND NOT bad1 THEN 'plain' ELSE 'alone' END AS way FROM y),
        f AS (SELECT *, CASE WHEN way <> 'alone' THEN way WHEN steps = 1 THEN 'ok' WHEN steps = 2 THEN 'plain' WHEN {alone("t2")} THEN 'plainest' WHEN length(t2) > {MOST_CHARS} THEN 'failed: max_tokens' ELSE 'failed: $.input' END AS status,
            CASE WHEN single THEN 0 WHEN way = 'ok' THEN 1 WHEN way = 'plain' THEN 2 ELSE 1 + (NOT long0)::INT END + CASE WHEN way = 'alone' THEN sum(steps) OVER (PARTITION BY batch, chunk) ELSE 0 END AS asked FROM z),
        g AS (SELECT *, CASE status WHEN 'ok' THEN t0 WHEN 'plain' THEN t1 WHEN 'plainest' THEN t2 END AS sent_text FROM f)
        SELECT doc_id, batch, chunk, status, asked::BIGINT AS asked, length(sent_text) AS sent, (length(sent_text) - length(replace(sent_text, 'e', ''))) AS e FROM g"""


#: Additions to the cache: a document's content is in round r if its id is divisible by r; in one round contents are forgotten.
ROUNDS, FORGETS, FORGOTTEN = 7, 5, 3


def cache_deltas(spark, sf_dir):
    """The embedding cache after several builds: which round each content comes from that isn't forgotten. Rounds are deltas of
    a store, merged by size on the way."""
    place = store.Store(spark, f"{C._shared_folder(spark)}/store")
    docs = C._table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("content_hash"), F.lit("m").alias("model"), F.lit(1).alias("dimensions"))
    for r in range(1, ROUNDS + 1):
        if r == FORGETS:
            place.forget(docs.where(F.col("doc_id") % FORGOTTEN == 0))
        else:
            rows = docs.where(F.col("doc_id") % r == 0).drop("doc_id").distinct()
            delta = place.write_delta(rows.withColumn("vector", F.array(F.lit(r).cast("float"))))
            place.commit(lambda number, delta=delta: [store.added(delta, number)])
        place.compact()
    return place.cache().select("content_hash", F.col("vector")[0].cast("long").alias("round"))


CACHE_DELTAS_SQL = f"""
    SELECT content_hash, max(round) AS round FROM (SELECT md5(text) AS content_hash, r AS round, max(CASE WHEN doc_id % {FORGOTTEN} = 0 THEN {FORGETS} ELSE 0 END) OVER (PARTITION BY text) AS forgotten, doc_id FROM documents, range(1, {ROUNDS + 1}) t(r))
    WHERE round <> {FORGETS} AND doc_id % round = 0 AND round > forgotten GROUP BY content_hash"""


def _repository(docs: DataFrame, version: int) -> DataFrame:
    """rel_path, content (bytes) of the files that are written before a build: of each document by the remainder of its id one
    that stays, one that is changed, one that goes and one that is new, and two that are never indexed."""
    d, lang = F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("none"))
    words = C.words()
    xml = F.concat(F.lit("<a>"), F.coalesce("text", F.lit("")), F.lit("</a>"))
    source = lambda name: F.concat(F.lit(f"def {name}"), d, F.lit('(): return "'), words, F.lit('"\n'))
    at = lambda folder, letter, ext: F.concat(F.lit(folder), lang, F.lit(f"/{letter}"), d, F.lit(ext))
    i = F.col("doc_id") % 4
    if version == 1:
        files = [(i != 3, F.when(i == 1, at("src/", "U", ".py")).otherwise(at("src/", "U", ".xml")), F.when(i == 1, source("f")).otherwise(xml)), (F.lit(True), at("build/", "I", ".py"), source("ignored")), (F.lit(True), at("lib/.git/", "G", ".py"), source("git"))]
    else:  # in Latin-1
        files = [(i == 1, at("src/", "U", ".py"), source("g")), (i == 3, at("src/", "U", ".py"), F.concat(F.lit("# é\n"), source("n")))]
    rows = F.explode(F.array(*[F.struct(keep.alias("keep"), path.alias("rel_path"), F.encode(content, "UTF-8" if version == 1 else "ISO-8859-1").alias("content")) for keep, path, content in files]))
    return docs.select(rows.alias("r")).select("r.*").where("keep").drop("keep")


def _put(root: str, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Writes files; one without content is deleted."""
    for part in parts:
        for row in part.itertuples(index=False):
            path = os.path.join(root, row.rel_path)
            if row.content is None:
                with contextlib.suppress(FileNotFoundError):  # by an attempt before this one
                    os.remove(path)
            else:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as file:
                    file.write(row.content)
        yield pd.DataFrame({"n": [len(part)]})


def build_twice(spark, sf_dir):
    """A full build, changes to the files, and an incremental build: the units of the newer version, opened by its name, and
    whether their contents had to be embedded again."""
    folder, docs = C._shared_folder(spark), C._table(spark, sf_dir, "documents")
    root, embedder = f"{folder}/repo", embed.HashingEmbedder(C.DIMENSIONS)
    put = lambda rows: rows.mapInPandas(lambda it: _put(root, it), "n long").agg(F.sum("n")).collect()
    os.makedirs(root, exist_ok=True)
    put(spark.createDataFrame([(".gitignore", bytearray(b"# not indexed\nbuild/\n"))], "rel_path string, content binary"))
    put(_repository(docs, 1))
    build.build_index(spark, root, f"{folder}/store", embedder, with_report=False)
    put(_repository(docs, 2))
    put(docs.where("doc_id % 4 = 2").select(F.concat(F.lit("src/"), F.coalesce("lang", F.lit("none")), F.lit("/U"), "doc_id", F.lit(".xml")).alias("rel_path"), F.lit(None).cast("binary").alias("content")))
    built = build.build_index(spark, root, f"{folder}/store", embedder, incremental_build=True, with_report=False)
    engine = search.open_index(spark, f"{folder}/store", built.index_name)
    again = spark.read.parquet(f"{built.location}/embedded").select("content_hash", F.lit(True).alias("embedded"))
    found = engine.units.join(engine.vectors.select("unit_id"), "unit_id", "left_semi").join(again, "content_hash", "left")
    return found.select("path", "unit_type", "name", "package", "content_hash", F.coalesce("embedded", F.lit(False)).alias("embedded"))


BUILD_TWICE_SQL = f"""
    WITH docs AS (SELECT doc_id AS d, doc_id % 4 AS i, coalesce(lang, 'none') AS lang, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g') AS w FROM documents),
    files AS (SELECT *, v, 'src/' || lang || '/U' || d || (CASE WHEN i IN (1, 3) THEN '.py' ELSE '.xml' END) AS path,
        CASE WHEN i IN (0, 2) THEN '<a>' || t || '</a>' WHEN i = 1 THEN 'def ' || (CASE WHEN v = 1 THEN 'f' ELSE 'g' END) || d || '(): return "' || w || '"' || chr(10) ELSE '# é' || chr(10) || 'def n' || d || '(): return "' || w || '"' || chr(10) END AS content
        FROM docs, range(1, 3) t(v) WHERE NOT (v = 1 AND i = 3) AND NOT (v = 2 AND i = 2)),
    units AS (SELECT v, path, 'file' AS unit_type, split_part(path, '/', -1) AS name, lang, content FROM files
        UNION ALL SELECT v, path, 'function', (CASE WHEN i = 3 THEN 'n' WHEN v = 1 THEN 'f' ELSE 'g' END) || d, lang, rtrim(CASE WHEN i = 3 THEN content[5:] ELSE content END, chr(10)) FROM files WHERE i IN (1, 3)),
    hashed AS (SELECT *, md5(CASE WHEN unit_type = 'function' AND length(content) > {T.UNIT_CUT} THEN left(content, {T.UNIT_CUT}) || '... [content truncated]' ELSE content END) AS content_hash FROM units)
    SELECT path, unit_type, name, 'src.' || lang AS package, content_hash, content_hash NOT IN (SELECT content_hash FROM hashed WHERE v = 1) AS embedded FROM hashed WHERE v = 2"""


def listing_filtered(spark, sf_dir):
    """Files of one language that are longer than most, by a walk that opens no folder of another one."""
    root = f"{C._shared_folder(spark)}/repo"
    os.makedirs(f"{root}/src/en", exist_ok=True)
    _repository(C._table(spark, sf_dir, "documents"), 1).mapInPandas(lambda it: _put(root, it), "n long").agg(F.sum("n")).collect()
    found = repository.listing(spark, root).where("rel_path like 'src/en/%' and extension in ('.xml', '.py') and size > 1000 and not ignored")
    return found.select("rel_path", "extension", "size")


LISTING_SQL = """
    SELECT 'src/en/U' || doc_id || ext AS rel_path, ext AS extension, strlen(content) AS size FROM (
        SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN '.py' ELSE '.xml' END AS ext, CASE WHEN doc_id % 4 = 1 THEN 'def f' || doc_id || '(): return "' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g') || '"' || chr(10) ELSE '<a>' || coalesce(text, '') || '</a>' END AS content
        FROM documents WHERE lang = 'en' AND doc_id % 4 <> 3) WHERE strlen(content) > 1000"""


#: Batches that the events of change_stream come in.
PARTS = 3


def change_stream(spark, sf_dir):
    """All events as events of files, through a stream in several batches in which many come after newer ones: how each file
    differs at the end from a listing of what was first seen of some."""
    folder = C._shared_folder(spark)
    rows = C._table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 5).cast("string"), F.lit(".py")).alias("rel_path"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("double").alias("mtime"), F.floor(F.col("value")).cast("long").alias("size"),
        F.col("ts").cast("timestamp").alias("event_time"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("seq"),
    )
    first = rows.groupBy("rel_path").agg(F.min_by(F.struct("mtime", "size", "seq"), F.struct("event_time", "seq")).alias("r")).where("r.seq % 2 = 0")
    previous = tables.materialize(first.select("rel_path", "r.mtime", "r.size"), "previous")
    for part in range(PARTS):  # each is a batch; events of all times are in all of them
        rows.where(F.col("seq") % PARTS == part).write.mode("append").json(f"{folder}/events")
    schema = f"{files.EVENTS}, seq long"
    each = -(-len(spark.read.schema(schema).json(f"{folder}/events").inputFiles()) // PARTS)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, each)).json(f"{folder}/events")
    files.kept(files.tracked(stream, previous, late="100000 days"), f"{folder}/checkpoint", f"{folder}/changes").awaitTermination()
    return files.latest_changes(spark, f"{folder}/changes").select("rel_path", F.col("n").alias("n_events"), "change", "mtime", "size")


STREAM_SQL = """
    WITH e AS (SELECT 'u' || user_id || '/' || (event_id % 5) || '.py' AS rel_path, floor(epoch_us(ts) / 60000000)::DOUBLE AS mtime, floor(value)::BIGINT AS size, event_type = 'error' AS deleted, ts, event_id FROM events),
    p AS (SELECT rel_path, arg_max(mtime, (ts, event_id)) AS mtime, arg_max(size, (ts, event_id)) AS size, arg_max(deleted, (ts, event_id)) AS deleted, count(*) AS n,
        arg_min(event_id, (ts, event_id)) % 2 = 0 AS known, arg_min(mtime, (ts, event_id)) AS was, arg_min(size, (ts, event_id)) AS had FROM e GROUP BY rel_path)
    SELECT rel_path, n AS n_events, CASE WHEN deleted THEN CASE WHEN known THEN 'deleted' ELSE 'gone' END WHEN NOT known THEN 'new' WHEN mtime = was AND size = had THEN 'unchanged' ELSE 'modified' END AS change,
        CASE WHEN NOT deleted THEN mtime END AS mtime, CASE WHEN NOT deleted THEN size END AS size FROM p"""


def knn_cells(spark, sf_dir):
    """The five nearest of every vector whose id is divisible by 100, by way of a written index in cells, and for each of these
    queries the share of its true neighbours that it found. Cells are learned, so no SQL says the same; tests hold the recall."""
    vectors, names = C._table(spark, sf_dir, "embeddings"), {"key": "vec_id", "vector": "embedding"}
    codebook, path = cells.learn(vectors, 5, **names), f"{tables.shared_dir(spark)}/codeloom-cells-{uuid.uuid4().hex}"
    cells.write_cells(vectors, codebook, path, **names)
    held = spark.read.schema("vec_id long, embedding array<float>, cell int").parquet(path)
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = tables.materialize(cells.knn_batch(held, codebook, queries, 5, **names), "found")
    right = cells.recall(found, index.knn_batch(vectors, queries, 5, **names), key="vec_id")
    return C._hits(found.join(right, "query_id"))


def unit_changes(spark, sf_dir):
    """Documents as units of two versions: some went, some came, some have another content, some another path."""
    docs = C._table(spark, sf_dir, "documents")

    def version(old: bool) -> DataFrame:
        d = F.col("doc_id")
        place = F.when(d % 7 == 0, d + 1).otherwise(d) if old else d
        body = F.when(d % 5 == 0, F.concat("text", F.lit("old"))).otherwise(F.col("text")) if old else F.col("text")
        path = F.concat(F.lit("src/"), "source", F.lit("/"), (place % 40).cast("string"), F.lit(".py"))
        return docs.where(d % 9 != 0 if old else d % 8 != 0).select(path.alias("path"), F.col("lang").alias("name"), F.lit("file").alias("unit_type"), F.when(d % 4 != 0, F.col("source")).alias("package"), F.lit(None).cast("string").alias("class_name"), T.content_hash(body).alias("content_hash"))

    return incremental.unit_changes(version(False), version(True))


UNIT_CHANGES_SQL = """
    WITH u AS (SELECT 'src/' || source || '/' || ((CASE WHEN v = 0 AND doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END) % 40) || '.py' AS path, lang AS name, CASE WHEN doc_id % 4 <> 0 THEN source END AS package,
        md5(CASE WHEN v = 0 AND doc_id % 5 = 0 THEN text || 'old' ELSE text END) AS h, v FROM documents, range(2) t(v) WHERE (v = 0 AND doc_id % 9 <> 0) OR (v = 1 AND doc_id % 8 <> 0)),
    b AS (SELECT path, name, package, h, count(*) FILTER (v = 1) AS now, count(*) FILTER (v = 0) AS was FROM u GROUP BY ALL),
    s AS (SELECT *, least(now, was) AS same, now - least(now, was) AS plus, was - least(now, was) AS minus FROM b),
    c AS (SELECT *, least(sum(plus) OVER i, sum(minus) OVER i) AS common, coalesce(sum(plus) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(minus) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mb
        FROM s WINDOW i AS (PARTITION BY path, name, package), o AS (PARTITION BY path, name, package ORDER BY h)),
    d AS (SELECT *, greatest(0, least(plus, common - pb)) AS changed, plus - greatest(0, least(plus, common - pb)) AS plus2, minus - greatest(0, least(minus, common - mb)) AS minus2 FROM c),
    e AS (SELECT *, least(sum(plus2) OVER i, sum(minus2) OVER i) AS common2, coalesce(sum(plus2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb2, coalesce(sum(minus2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mb2
        FROM d WINDOW i AS (PARTITION BY h), o AS (PARTITION BY h ORDER BY path NULLS FIRST, name NULLS FIRST, package NULLS FIRST)),
    f AS (SELECT *, greatest(0, least(plus2, common2 - pb2)) AS moved, greatest(0, least(minus2, common2 - mb2)) AS off FROM e),
    g AS (SELECT path, name, package, h, unnest([{'change': 'unchanged', 'n': same}, {'change': 'changed', 'n': changed}, {'change': 'moved', 'n': moved}, {'change': 'new', 'n': plus2 - moved}, {'change': 'gone', 'n': minus2 - off}]) AS k FROM f)
    SELECT path, name, 'file' AS unit_type, package, NULL::VARCHAR AS class_name, h AS content_hash, k.change AS change, k.n::BIGINT AS n FROM g WHERE k.n > 0"""


def catalog_ancestor(spark, sf_dir):
    """All events as commits, each with one or two made-up parents; of each the nearest ancestor that has an index."""
    events, e = C._table(spark, sf_dir, "events"), F.col("event_id")
    graph = events.where("event_id > 0").select(e.alias("commit"), F.expr("event_id div 2").alias("parent")).union(events.where("event_id > 0 and event_id % 7 = 0").select(e, F.expr("event_id div 3")))
    return catalog.nearest_indexed(graph, events.where("event_type = 'signup'").select(e.alias("commit"), F.col("ts").alias("indexed_on")), events.select(e.alias("commit")))


ANCESTOR_SQL = """
    WITH RECURSIVE graph AS (SELECT event_id AS commit, event_id // 2 AS parent FROM events WHERE event_id > 0 UNION SELECT event_id, event_id // 3 FROM events WHERE event_id > 0 AND event_id % 7 = 0),
    indexed AS (SELECT event_id AS commit, ts FROM events WHERE event_type = 'signup'),
    up AS (SELECT commit, parent AS node, 1 AS steps FROM graph WHERE parent IN (SELECT event_id FROM events)
        UNION SELECT up.commit, g.parent, steps + 1 FROM up JOIN graph g ON g.commit = up.node WHERE up.node NOT IN (SELECT commit FROM indexed))
    SELECT commit, node AS ancestor, steps FROM (SELECT up.commit, node, steps, row_number() OVER (PARTITION BY up.commit ORDER BY steps, ts DESC, node) AS i FROM up JOIN indexed x ON x.commit = node) WHERE i = 1"""


def units_rollup(spark, sf_dir):
    """Documents by language and source, by language, and all: counts, sizes, the five longest and how many more."""
    found = report.rolled(C._documents(spark, sf_dir), ["lang", "source"], order="doc_id")
    return found.select("lang", "source", "level", "n", "size", F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["at"].cast("string"), x["size"].cast("string"))), ",").alias("top"), F.col("more").cast("long").alias("more"))


ROLLUP_SQL = """
    SELECT lang, source, grouping(lang, source)::BIGINT AS level, count(*) AS n, sum(length(text))::BIGINT AS size, array_to_string(list(doc_id || ':' || length(text) ORDER BY length(text) DESC, doc_id)[1:5], ',') AS top, greatest(0, count(*) - 5) AS more
    FROM documents GROUP BY ROLLUP(lang, source)"""


def report_document(spark, sf_dir):
    """The counts and the lists of a build's report, a row for each: of files by state, folders that weren't entered, units by kind and
    language, and the files listed first."""
    folder = C._shared_folder(spark)
    root = f"{folder}/repo"
    os.makedirs(root, exist_ok=True)
    put = lambda rows: rows.mapInPandas(lambda it: _put(root, it), "n long").agg(F.sum("n")).collect()
    put(spark.createDataFrame([(".gitignore", bytearray(b"build/\n*.xml.bak\n"))], "rel_path string, content binary"))
    put(_repository(C._table(spark, sf_dir, "documents"), 1))
    out = build.build_index(spark, root, f"{folder}/store", embed.HashingEmbedder(C.DIMENSIONS)).report
    files, code, folders = out["file_processing"], out["code_units"], out["folders"]
    rows = [("files", "total", files["total"], None)] + [("state", f"{r['status']} {r['skip_reason'] or ''}".strip(), r["n"], None) for r in files["counts"]]
    rows += [("extension", r["extension"], r["n"], None) for r in files["extensions"]] + [("processed", r["rel_path"], r["n_units"], r["size"]) for r in files["processed_files"]]
    rows += [("more", "processed", sum(r["n"] for r in files["counts"] if r["status"] == "processed") - len(files["processed_files"]), None), ("units", "total", code["n"], code["size"])]
    rows += [("kind", r["unit_type"], r["n"], r["size"]) for r in code["by_type"]] + [("language", r["language"], r["n"], r["size"]) for r in code["by_language"]]
    rows += [("folder", r["reason"], r["n"], None) for r in folders["counts"]] + [("skipped", path, i, None) for i, path in enumerate(folders["skipped"])]
    return spark.createDataFrame(rows, "section string, name string, n long, size long")


REPORT_SQL = f"""
    WITH docs AS (SELECT doc_id AS d, doc_id % 4 AS i, coalesce(lang, 'none') AS lang, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g') AS w FROM documents),
    files AS (SELECT 'src/' || lang || '/U' || d || (CASE WHEN i = 1 THEN '.py' ELSE '.xml' END) AS path, CASE WHEN i = 1 THEN '.py' ELSE '.xml' END AS ext, i, CASE WHEN i = 1 THEN 'def f' || d || '(): return "' || w || '"' || chr(10) ELSE '<a>' || t || '</a>' END AS content FROM docs WHERE i <> 3),
    units AS (SELECT 'file' AS kind, ext, length(replace(content, chr(13) || chr(10), chr(10))) AS size FROM files UNION ALL SELECT 'function', ext, CASE WHEN length(content) - 1 > {T.UNIT_CUT} THEN {T.UNIT_CUT + len("... [content truncated]")} ELSE length(content) - 1 END FROM files WHERE i = 1),
    listed AS (SELECT path, 1 + (i = 1)::INT AS n, strlen(content) AS size, row_number() OVER (ORDER BY path) AS k FROM files)
    SELECT 'files' AS section, 'total' AS name, count(*) + 1 AS n, NULL::BIGINT AS size FROM files
    UNION ALL SELECT 'state', 'processed', count(*), NULL FROM files UNION ALL SELECT 'state', 'skipped unsupported', 1, NULL
    UNION ALL SELECT 'extension', ext, count(*), NULL FROM files GROUP BY ext UNION ALL SELECT 'extension', '', 1, NULL
    UNION ALL SELECT 'processed', path, n, size FROM listed WHERE k <= {report.FILES_SHOWN} UNION ALL SELECT 'more', 'processed', greatest(0, count(*) - {report.FILES_SHOWN}), NULL FROM files
    UNION ALL SELECT 'units', 'total', count(*), sum(size)::BIGINT FROM units UNION ALL SELECT 'kind', kind, count(*), sum(size)::BIGINT FROM units GROUP BY kind
    UNION ALL SELECT 'language', ext[2:], count(*), sum(size)::BIGINT FROM units GROUP BY ext
    UNION ALL SELECT * FROM (VALUES ('folder', 'git', 1, NULL), ('folder', 'ignored', 1, NULL), ('skipped', 'build', 0, NULL), ('skipped', 'lib/.git', 1, NULL))"""


#: An Erlang file for each document, of which {d} is the id and {w} the text with letters, digits and spaces only.
ERLANG = '-module(m{d}).\n-export([start/1]).\n\n%% stop(never). {w}\nstart(X) when X > {d} ->\n    io:format("a. b(~p). {w}", [$., X]),\n    stop();\nstart(_) -> {error, "no. {w}"}.\n\n\'Quoted Name\'() ->\n    ok.\n'


def erlang_units(spark, sf_dir):
    """Units of Erlang files, whose scanner is asked for; without it they are one unit each."""
    words = C.words()
    content = F.replace(F.replace(F.lit(ERLANG), F.lit("{d}"), F.col("doc_id").cast("string")), F.lit("{w}"), words)
    rows = C._table(spark, sf_dir, "documents").select(F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.lit(".erl")).alias("rel_path"), content.alias("content"))
    both = [units.parse_texts(rows, erlang_too=asked).withColumn("scanned", F.lit(asked)) for asked in (True, False)]
    return both[0].unionByName(both[1]).select("scanned", "rel_path", F.col("pos").cast("long").alias("pos"), "unit_type", "name", F.md5("content").alias("content_hash"))


def _erlang_sql() -> str:
    start, quoted = ERLANG.index("start(X)"), ERLANG.index("'Quoted")
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    made = lambda text: f"replace(replace({quote(text)}, '{{d}}', doc_id::VARCHAR), '{{w}}', w)"
    cut = lambda text: f"CASE WHEN length({made(text)}) > {T.UNIT_CUT} THEN left({made(text)}, {T.UNIT_CUT}) || '... [content truncated]' ELSE {made(text)} END"
    rows = [("true", 0, "file", "'m' || doc_id || '.erl'", made(ERLANG)), ("true", 1, "function", "'start'", cut(ERLANG[start : quoted - 2])), ("true", 2, "function", quote("'Quoted Name'"), cut(ERLANG[quoted:-1])), ("false", 0, "file", "'m' || doc_id || '.erl'", made(ERLANG))]
    parts = " UNION ALL ".join(f"SELECT {scanned} AS scanned, 'src/m' || doc_id || '.erl' AS rel_path, {pos}::BIGINT AS pos, '{kind}' AS unit_type, {name} AS name, md5({content}) AS content_hash FROM docs" for scanned, pos, kind, name, content in rows)
    return f"WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g') AS w FROM documents) {parts}"


def highlight_languages(spark, sf_dir):
    """The highlighter's language for the extension of a path of each document, all extensions in turn and some that have none."""
    every = [*P.HIGHLIGHT, "", "txt", "java.bak", "PY"]
    name = F.element_at(F.array(*[F.lit(x) for x in every]), (F.col("doc_id") % len(every) + 1).cast("int"))
    return C._table(spark, sf_dir, "documents").select("doc_id", P.highlight_language(F.concat(F.lit("a.b/c"), F.col("doc_id").cast("string"), F.when(name != "", F.concat(F.lit("."), name)).otherwise(F.lit("")))).alias("language"))


HIGHLIGHT_SQL = f"""SELECT doc_id, coalesce(map_extract(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in P.HIGHLIGHT.items())}, 'PY': 'python'}}, x)[1], '') AS language
    FROM (SELECT doc_id, ([{", ".join(f"'{x}'" for x in (*P.HIGHLIGHT, "", "txt", "java.bak", "PY"))}])[doc_id % {len(P.HIGHLIGHT) + 4} + 1] AS x FROM documents)"""


def resized_vectors(spark, sf_dir):
    """Every vector cut to 48 and filled to 80 numbers, in millionths."""
    shown = lambda n: F.array_join(F.transform(V.resize("embedding", n), lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string")), ",")
    return C._table(spark, sf_dir, "embeddings").select("vec_id", shown(48).alias("cut"), shown(80).alias("filled"))


RESIZED_SQL = """SELECT vec_id, array_to_string(v[1:48], ',') AS cut, array_to_string(v, ',') || repeat(',0', 16) AS filled
    FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT::VARCHAR) AS v FROM embeddings)"""


def search_by_name(spark, sf_dir):
    """The ten units nearest to the first benchmark text in an index that is opened by its name, as a console and a service show them."""
    folder = C._shared_folder(spark)
    root, embedder = f"{folder}/repo", embed.HashingEmbedder(C.DIMENSIONS)
    os.makedirs(root, exist_ok=True)
    docs = C._table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("src/"), F.coalesce("lang", F.lit("none")), F.lit("/U"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("rel_path"), F.encode(F.concat(F.lit("<a>"), F.coalesce("text", F.lit("")), F.lit("</a>")), "UTF-8").alias("content"))
    rows.mapInPandas(lambda it: _put(root, it), "n long").agg(F.sum("n")).collect()
    named = build.build_index(spark, root, f"{folder}/store", embedder, with_report=False).index_name
    asked = C._questions(spark, sf_dir).orderBy("query_id").limit(1).collect()
    if not asked:
        return spark.createDataFrame([], "rank int, line string, path string, content string, language string")
    found = search.search(spark, f"{folder}/store", asked[0]["query"], 10, named, embedder)
    shown = search.json_rows(found).select("path", "content", "language")
    return search.console_lines(found).join(found.select("rank", "path"), "rank").join(shown, "path").select("rank", "line", "path", "content", "language")


SEARCH_SQL = f"""
    WITH files AS (SELECT doc_id AS d, 'src/' || coalesce(lang, 'none') AS folder, '<a>' || replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) || '</a>' AS content FROM documents),
    own AS (SELECT *, row_number() OVER (ORDER BY folder, folder || '/U' || d || '.xml') - 1 AS id FROM files),
    asked AS (SELECT -1 AS id, text FROM benchmark ORDER BY item_id LIMIT 1),
    texts AS ({C._prepared_sql("SELECT id, content AS text FROM own")} UNION ALL SELECT id, text FROM asked), {C.HASHED_SQL}, {C.NEAREST_SQL}
    SELECT rank, rank || '. ' || folder || '/U' || d || '.xml (score ' || printf('%.2f', 1 / (1 + d2)) || ')' || chr(10) || '   file U' || d || '.xml' || chr(10) || '   package: ' || replace(folder, '/', '.') || chr(10) || (CASE WHEN length(content) > {T.PREVIEW_CONSOLE} THEN left(content, {T.PREVIEW_CONSOLE}) || '...' ELSE content END) AS line,
        folder || '/U' || d || '.xml' AS path, left(content, {T.PREVIEW_JSON}) AS content, 'xml' AS language FROM (SELECT id, greatest(d2, 0)::DOUBLE AS d2, (row_number() OVER (ORDER BY d2, id))::INT AS rank FROM near) JOIN own USING (id) WHERE rank <= 10"""


def metadata_scan(spark, sf_dir):
    """Size of every file of a repository, ignored ones and those of .git too."""
    root = f"{C._shared_folder(spark)}/repo"
    os.makedirs(root, exist_ok=True)
    put = lambda rows: rows.mapInPandas(lambda it: _put(root, it), "n long").agg(F.sum("n")).collect()
    put(spark.createDataFrame([(".gitignore", bytearray(b"build/\n"))], "rel_path string, content binary"))
    put(_repository(C._table(spark, sf_dir, "documents"), 1))
    return repository.metadata(spark, root).select("rel_path", "size")


METADATA_SQL = """
    WITH docs AS (SELECT doc_id AS d, doc_id % 4 AS i, coalesce(lang, 'none') AS lang, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g') AS w FROM documents)
    SELECT 'src/' || lang || '/U' || d || (CASE WHEN i = 1 THEN '.py' ELSE '.xml' END) AS rel_path, strlen(CASE WHEN i = 1 THEN 'def f' || d || '(): return "' || w || '"' || chr(10) ELSE '<a>' || t || '</a>' END) AS size FROM docs WHERE i <> 3
    UNION ALL SELECT 'build/' || lang || '/I' || d || '.py', strlen('def ignored' || d || '(): return "' || w || '"' || chr(10)) FROM docs
    UNION ALL SELECT 'lib/.git/' || lang || '/G' || d || '.py', strlen('def git' || d || '(): return "' || w || '"' || chr(10)) FROM docs UNION ALL SELECT '.gitignore', 7"""


def history_record(spark, sf_dir):
    """The query log of one half of the conversations with those of the other half put in front, each query once."""
    log = C._table(spark, sf_dir, "conversations").where("role = 'user'")
    part = lambda odd: log.where(F.col("conv_id").bitwiseAND(1) == odd).select(F.col("text").alias("query"), F.struct(F.lit(odd).alias("new"), "conv_id", "turn").alias("ts"))
    return history.record(part(0), part(1)).select("query", "ts.new", "ts.conv_id", "ts.turn")


HISTORY_SQL = f"""
    SELECT query, ts.new AS new, ts.conv_id AS conv_id, ts.turn AS turn FROM (SELECT text AS query, max({{'new': (conv_id & 1)::INT, 'conv_id': conv_id, 'turn': turn}}) AS ts FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY text ORDER BY ts DESC, query LIMIT {history.KEEP})"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (embed_ladder, cache_deltas, build_twice, listing_filtered, change_stream, knn_cells, unit_changes, catalog_ancestor, units_rollup, report_document, erlang_units, highlight_languages, resized_vectors, search_by_name, metadata_scan, history_record)}

ORACLE_SQL: dict[str, str] = {"embed_ladder": _ladder_sql(), "cache_deltas": CACHE_DELTAS_SQL, "build_twice": BUILD_TWICE_SQL, "listing_filtered": LISTING_SQL, "change_stream": STREAM_SQL, "unit_changes": UNIT_CHANGES_SQL, "catalog_ancestor": ANCESTOR_SQL, "units_rollup": ROLLUP_SQL, "report_document": REPORT_SQL, "erlang_units": _erlang_sql(), "highlight_languages": HIGHLIGHT_SQL, "resized_vectors": RESIZED_SQL, "search_by_name": SEARCH_SQL, "metadata_scan": METADATA_SQL, "history_record": HISTORY_SQL}
