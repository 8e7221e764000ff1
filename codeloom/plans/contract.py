"""Queries over the test tables, and the SQL that says the same.

The tables hold no repository, so documents stand for units (doc_id is seq, text content, lang
language, source package), embeddings for vectors, user turns for a query log, events for a registry
of indexes, and paths are made up from documents.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import tables
from codeloom.functions import text as T
from codeloom.functions import vectors as V
from codeloom.operators import batching, cache, catalog, embed, history, incremental, index, report, units
from codeloom.plans import build, search
from codeloom.sources import ignore, repository

DIMENSIONS = 64
EXTENSIONS = (".java", ".py", ".xml", ".PNG", ".txt", "", ".tar.gz")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumn("size", F.length("text").cast("long"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("repo/"), "source", F.lit("/"), "lang", F.when(F.col("doc_id") % 5 == 0, "/.h").otherwise("/d"), F.col("doc_id").cast("string"), ext)
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("ext", P.extension("path"))


PATHS_SQL = f"""SELECT doc_id, path, lower(regexp_extract(path, '^(?:.*/)?\\.*[^/.][^/]*?(\\.[^./]*)$', 1)) AS ext FROM (
    SELECT doc_id, 'repo/' || source || '/' || lang || (CASE WHEN doc_id % 5 = 0 THEN '/.h' ELSE '/d' END) || doc_id ||
    ([{", ".join(f"'{e}'" for e in EXTENSIONS)}])[doc_id % {len(EXTENSIONS)} + 1] AS path FROM documents)"""


def units_by_type(spark, sf_dir):
    return report.by(_documents(spark, sf_dir), "source")


def units_by_language(spark, sf_dir):
    return report.by(_documents(spark, sf_dir), "lang")


def _by_sql(key: str) -> str:
    return f"SELECT {key}, count(*) AS n, sum(length(text))::BIGINT AS size, round(sum(length(text)) / count(*), 2) AS avg_size FROM documents GROUP BY {key}"


def corpus_totals(spark, sf_dir):
    return report.totals(_documents(spark, sf_dir))


def largest_units(spark, sf_dir):
    return report.largest(_documents(spark, sf_dir), order="doc_id").select("doc_id", "lang", "source", "size")


def content_hash_dedup(spark, sf_dir):
    units = _documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), T.content_hash("text").alias("content_hash"))
    return cache.distinct_contents(units)


def path_parts(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    return rows.select("doc_id", P.basename("path").alias("base"), "ext", P.package("path").alias("package"), P.language("ext").alias("language"), P.highlight_language("path").alias("highlight"), P.relative("path", "repo/").alias("rel"))


def skip_reason_counts(spark, sf_dir):
    rows = _paths(spark, sf_dir).withColumn("skip_reason", F.coalesce(repository.skip_reason("ext"), F.lit("parsed")))
    return rows.groupBy("skip_reason").agg(F.count("*").alias("n"))


def token_estimate(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.token_estimate("text").alias("tokens"))


def sanitize_basic(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.sanitize("text")).alias("clean"))


def sanitize_aggressive(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.sanitize_aggressive("text")).alias("clean"))


def prepare_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.prepare("text")).alias("clean"))


def truncate_unit(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.truncate_unit("text")).alias("cut"))


def preview(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.preview("text").alias("preview"))


def batch_plan(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", T.token_estimate("text").alias("tokens"))
    return batching.plan(rows, "doc_id", "tokens")


def _cached(units: DataFrame, one_in: int) -> DataFrame:
    return units.where(F.col("doc_id") % one_in == 0).select("content_hash").distinct()


def cache_lookup(spark, sf_dir):
    units = _documents(spark, sf_dir).select("doc_id", T.content_hash("text").alias("content_hash"))
    return cache.hit_counts(cache.lookup(units, _cached(units, 3)))


def cache_merge(spark, sf_dir):
    units = _documents(spark, sf_dir).select("doc_id", T.content_hash("text").alias("content_hash"))
    parts = [_cached(units, n).withColumn("origin", F.lit(name)) for n, name in ((1, "old"), (3, "shared"), (5, "new"))]
    return cache.merge(*parts, key=["content_hash"])


def _listings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The documents as files, and an earlier state of them: some missing, some older, some that are gone now."""
    now = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("rel_path"), "doc_id", F.lit(100.0).alias("mtime"), "size")
    old = now.where("doc_id % 7 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, 50.0).otherwise(F.col("mtime"))).withColumn("size", F.when(F.col("doc_id") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))
    gone = now.where("doc_id % 13 = 0").withColumn("rel_path", F.concat(F.lit("gone"), "rel_path"))
    return now, old.unionByName(gone)


LISTINGS_SQL = """
now AS (SELECT doc_id::VARCHAR AS rel_path, doc_id, 100.0 AS mtime, length(text) AS size FROM documents),
old AS (SELECT rel_path, CASE WHEN doc_id % 5 = 0 THEN 50.0 ELSE mtime END AS mtime, CASE WHEN doc_id % 11 = 0 THEN size + 1 ELSE size END AS size FROM now WHERE doc_id % 7 <> 0
    UNION ALL SELECT 'gone' || rel_path, mtime, size FROM now WHERE doc_id % 13 = 0),
changed AS (SELECT coalesce(n.rel_path, o.rel_path) AS rel_path,
    CASE WHEN o.rel_path IS NULL THEN 'new' WHEN n.rel_path IS NULL THEN 'deleted' WHEN n.mtime = o.mtime AND n.size = o.size THEN 'unchanged' ELSE 'modified' END AS change
    FROM now n FULL JOIN old o ON n.rel_path = o.rel_path)"""


def change_detection(spark, sf_dir):
    return incremental.changes(*_listings(spark, sf_dir))


def change_counts(spark, sf_dir):
    return incremental.change_counts(incremental.changes(*_listings(spark, sf_dir)))


def incremental_units(spark, sf_dir):
    now, old = _listings(spark, sf_dir)
    changed = incremental.changes(now, old)
    before = old.select(F.col("rel_path").alias("path"), F.lit("kept").alias("origin"))
    fresh = now.join(changed.where("change in ('new', 'modified')"), "rel_path", "left_semi").select(F.col("rel_path").alias("path"), F.lit("parsed").alias("origin"))
    return incremental.merged_units(before, changed, fresh)


def identity_dedup(spark, sf_dir):
    units = _documents(spark, sf_dir).select("doc_id", "lang", "source", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("doc_id") % 10).alias("part"), "size")
    return cache.identity_dedup(units, ["lang", "source", "part"], order="doc_id")


def vector_resize(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    both = [V.resize("embedding", n) for n in (48, 80)]
    return rows.select("vec_id", *[F.size(v).alias(f"size_{n}") for n, v in zip((48, 80), both)], *[F.round(V.norm(v), 6).alias(f"norm_{n}") for n, v in zip((48, 80), both)])


def _vector(spark, sf_dir, vec_id: int) -> list[float]:
    found = _table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").head()
    return list(found[0]) if found else []


def _hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("d2", F.round("d2", 6)).withColumn("score", F.round("score", 6))


def knn_single(spark, sf_dir):
    hits = index.knn(_table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 10, key="vec_id", vector="embedding")
    units = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return _hits(index.with_units(hits, units, "vec_id")).select("rank", "vec_id", "d2", "score", "lang", "source")


def knn_batch(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _hits(index.knn_batch(vectors, queries, 5, key="vec_id", vector="embedding"))


def knn_filtered(spark, sf_dir):
    good = _table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    vectors = _table(spark, sf_dir, "embeddings").join(good, "vec_id", "left_semi")
    return _hits(index.knn(vectors, _vector(spark, sf_dir, 0), 10, key="vec_id", vector="embedding"))


D2_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
ONE_SQL = f"""SELECT vec_id, {D2_SQL.format(a="embedding", b="(SELECT embedding FROM embeddings WHERE vec_id = 0)")} AS d FROM embeddings"""

def _prepared_sql(rows: str) -> str:
    """Rows (id, text) as an embedder gets them."""
    return f"""SELECT id, CASE WHEN {TOKENS_SQL.format(t='f')} <= {T.TOKENS_PER_TEXT} THEN f WHEN {BLANK_SQL.format(t='a')} THEN '{T.EMPTY}' ELSE a END AS text FROM (
        SELECT *, {ASCII_SQL.format(t='f')} AS a FROM (SELECT *, CASE WHEN {BLANK_SQL.format(t='c')} THEN '{T.PLACEHOLDER}' ELSE c END AS f FROM (SELECT id, {CLEAN_SQL.format(t=f"left(coalesce(text, ''), {T.TEXT_CUT})")} AS c FROM ({rows}))))"""


TOKENS_SQL = "CASE WHEN length({t}) = 0 THEN 0 ELSE length({t}) // 3 + 2 END"
CLEAN_SQL = "regexp_replace(regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g'), '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{FEFF}}]', '', 'g')"
BLANK_SQL = "regexp_full_match({t}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]*')"
ASCII_SQL = "regexp_replace(regexp_replace(regexp_replace({t}, '[^\\x00-\\x7F]', ' ', 'g'), '[\\s\\x0b]+', ' ', 'g'), '[\\\\\"''\\x00-\\x1f\\x7f]', ' ', 'g')"

#: Term counts by bucket, scaled to length 1, for rows (id, text).
HASHED_SQL = f"""
words AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM texts),
counted AS (SELECT id, ('0x' || left(md5(w), 7))::BIGINT % {DIMENSIONS} AS i, count(*) AS c FROM words GROUP BY 1, 2),
scaled AS (SELECT id, i, (c / sqrt((sum(c * c) OVER (PARTITION BY id))::DOUBLE))::FLOAT AS x FROM counted)"""
#: The k nearest of the units (id >= 0) to each query (id < 0): q, id, d2, rank. Products are added exactly, so equal vectors tie.
NEAREST_SQL = """
dots AS (SELECT q.id AS q, d.id AS d, sum((q.x::DOUBLE * d.x::DOUBLE)::DECIMAL(28, 20)) AS dot FROM scaled q JOIN scaled d USING (i) WHERE q.id < 0 AND d.id >= 0 GROUP BY 1, 2),
norms AS (SELECT t.id, coalesce(sum((x::DOUBLE * x::DOUBLE)::DECIMAL(28, 20)), 0) AS s FROM texts t LEFT JOIN scaled x ON x.id = t.id GROUP BY t.id),
near AS (SELECT q.id AS q, d.id AS id, q.s + d.s - 2 * coalesce(dot, 0) AS d2 FROM norms q JOIN norms d ON q.id < 0 AND d.id >= 0 LEFT JOIN dots ON dots.q = q.id AND dots.d = d.id),
nearest AS (SELECT q, id, round(greatest(d2, 0)::DOUBLE, 4) AS d2, (row_number() OVER (PARTITION BY q ORDER BY d2, id))::INT AS rank FROM near)"""


def hashed_embedding(spark, sf_dir):
    """The vector of each text as it is, in ten-thousandths."""
    docs = embed.HashingEmbedder(DIMENSIONS).vectors(_documents(spark, sf_dir), "doc_id", F.col("text"))
    return docs.select("doc_id", F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string")), ",").alias("vector"))


def _questions(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def text_search(spark, sf_dir):
    """The three documents nearest to each benchmark text, by way of a search engine over all documents."""
    embedder = embed.HashingEmbedder(DIMENSIONS)
    own = _documents(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.col("text").alias("content"), T.content_hash("text").alias("content_hash"))
    embedded = embedder.embed(own.groupBy("content_hash").agg(F.first("content").alias("content")))
    engine = search.SearchEngine(embedder, own.select("unit_id"), index.build_vectors(own, embedded, DIMENSIONS))
    return engine.search_all(_questions(spark, sf_dir), 3).select("query_id", "rank", "unit_id", F.round("d2", 4).alias("d2"))


def _registry(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    commit = F.when(F.col("event_id") % 4 != 0, F.md5(F.col("event_id").cast("string")))
    return rows.select(F.col("event_id").cast("string").alias("index_name"), P.safe_name(F.concat("event_type", F.lit("-"), (F.col("user_id") % 50).cast("string"))).alias("repo_name"), P.path_hash(F.concat(F.lit("/src/"), "event_type")).alias("path_hash"), commit.alias("commit"), (F.col("event_id") % 3 == 0).alias("is_modified"), F.col("ts").alias("indexed_on"))


REGISTRY_SQL = """registry AS (SELECT event_id::VARCHAR AS index_name, regexp_replace(event_type || '-' || (user_id % 50), '[^\\p{L}\\p{N}]', '_', 'g') AS repo_name, left(md5('/src/' || event_type), 8) AS path_hash,
    CASE WHEN event_id % 4 <> 0 THEN md5(event_id::VARCHAR) END AS commit, event_id % 3 = 0 AS is_modified, ts AS indexed_on FROM events)"""


def catalog_latest(spark, sf_dir):
    return catalog.latest_by_repository(_registry(spark, sf_dir)).select("repo_name", "path_hash", "index_name", "commit", "is_modified")


def catalog_display(spark, sf_dir):
    return catalog.displayed(_registry(spark, sf_dir)).select("name", "full_name", "git_version", "timestamp", "index_name")


def query_history(spark, sf_dir):
    log = _table(spark, sf_dir, "conversations").where("role = 'user'").select(F.lower("text").alias("query"), F.struct("conv_id", "turn").alias("ts"))
    return history.latest(history.matching(log, "a")).select("query", "ts.conv_id", "ts.turn")


def error_histogram(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("Error"), (F.col("user_id") % 7).cast("string")).alias("error_type"))
    return report.errors(rows)


def result_rows(spark, sf_dir):
    hits = index.knn(_table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 1), 10, key="vec_id", vector="embedding")
    units = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    found = index.with_units(hits, units, "vec_id")
    return found.select("rank", "vec_id", F.substring("text", 1, T.PREVIEW_JSON).alias("content"), "source", F.format_string("%.2f", F.round("score", 6)).alias("shown"))


def files_by_extension(spark, sf_dir):
    return report.files_by_extension(_paths(spark, sf_dir).withColumnRenamed("ext", "extension"))


RULES = ("src1/", "*.tar.gz", "/repo/src2/en", "repo/**/d*7.py", "!d17.py", "# note")


def ignored_paths(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    return rows.select("doc_id", ignore.ignored(F.col("path"), ignore.Ignore(list(RULES))).alias("ignored"))


def sanitize_extreme(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.sanitize_extreme("text")).alias("clean"))


#: Files by the remainder of doc_id, of which {d} is the id, {w} the whole text with letters, digits and spaces only, {t} the whole text.
FILES = (
    ("P", ".py", '@registered(name="é")\nclass P{d}(Base, metaclass=Meta):\n    """{w}"""\n    size = {d}\n    text: str = "ü"\n\n    def grow(self, by=(1, 2), *, unit="(m,2)"):\n        return "é"\n\n    class Inner:\n        def hidden(self): ...\n\nasync def make{d}(a,  b): return "{w}"\n'),
    ("B", ".py", "def broken(:\n# {t}"),
    ("J", ".java", 'package x;\n\n/** class Fake { void no() {} } */\n@Deprecated(since = "1")\npublic final class J{d}<T extends List<? super T>> extends Base<T> implements One, Two<String, T> {\n  private static final String SQL = "class X { }", OTHER = "}";\n  private final String block = """\n    class Inside { {w} }\n    """;\n\n  public J{d}(String name) { this.name = name; }\n\n  @Override\n  public <R> Map<String, R> parse(final String text, List<R> out) throws Exception {\n    // {w}\n    return null;\n  }\n  void add(int a) { char c = \'}\'; }\n  static class Nested { void inner() { } }\n}\n\ninterface Alone { void x(); }\n'),
    ("I", ".java", "package x;\ninterface I{d} { void x(); }\nenum E { A, B }\n// {w}\n"),
    ("X", ".xml", "<a>{t}</a>\n"),
    ("L", ".java", "class K{d} { int n; }\nclass L{d} extends K{d} {\n  void run() { int x = {d}; }\n  void run(int a, int b) { }\n}\n// {w}\n"),
)
#: What each file must give: position, type, name, class, content; no type stands for a file without units.
FOUND = (
    ((0, "file", "P{d}.py", None, FILES[0][2]), (1, "class", "P{d}", None, 'class P{d}(Base, metaclass=Meta): ... {\n  size\n  text\n  grow(self, by=(1, 2), *, unit="(m,2)")\n}'), (2, "method", "grow", "P{d}", 'def grow(self, by=(1, 2), *, unit="(m,2)"):\n        return "é"'), (3, "function", "make{d}", None, 'async def make{d}(a,  b): return "{w}"')),
    ((0, "file", "B{d}.py", None, FILES[1][2]), (1, None, None, None, None)),
    ((0, "class", "J{d}", None, "class J{d} extends Base<T> implements One, Two<String, T>: ... {\n  String SQL\n  String OTHER\n  String block\n  Map<String, R> parse(String text, List<R> out)\n  void add(int a)\n}"), (1, "method", "parse", "J{d}", "@Override\n  public <R> Map<String, R> parse(final String text, List<R> out) throws Exception {\n    // {w}\n    return null;\n  }"), (2, "method", "add", "J{d}", "void add(int a) { char c = '}'; }")),
    ((0, None, None, None, None),),
    ((0, "file", "X{d}.xml", None, FILES[4][2]),),
    ((0, "class", "K{d}", None, "class K{d}: ... {\n  int n\n}"), (1, "class", "L{d}", None, "class L{d} extends K{d}: ... {\n  void run()\n  void run(int a, int b)\n}"), (2, "method", "run", "L{d}", "void run() { int x = {d}; }"), (3, "method", "run", "L{d}", "void run(int a, int b) { }")),
)


def words() -> Column:
    """The text with letters, digits and spaces only, of ASCII. Java reads this class about ten times as fast as one of three ranges."""
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{Alnum} ]", " ")


def _sources(spark, sf_dir) -> DataFrame:
    """A Python, Java or XML file for each document, with its whole text in it."""
    text = F.coalesce("text", F.lit(""))
    values = (("{d}", F.col("doc_id").cast("string")), ("{w}", words()), ("{t}", text))
    path = content = None
    for i, (letter, ext, body) in enumerate(FILES):
        own = F.lit(body)
        for mark, value in values:
            own = F.replace(own, F.lit(mark), value) if mark in body else own
        name = F.concat(F.lit("src/"), F.coalesce("lang", F.lit("none")), F.lit(f"/{letter}"), F.col("doc_id").cast("string"), F.lit(ext))
        here = F.col("doc_id") % len(FILES) == i
        path, content = (F.when(here, name), F.when(here, own)) if path is None else (path.when(here, name), content.when(here, own))
    return _table(spark, sf_dir, "documents").select(path.alias("rel_path"), content.alias("content"))


def code_units(spark, sf_dir):
    parsed = units.parse_texts(_sources(spark, sf_dir))
    return parsed.select("rel_path", F.col("pos").cast("long").alias("pos"), "unit_type", "name", "package", "class_name", F.md5("content").alias("content_hash"), "error_type")


def code_unit_ids(spark, sf_dir):
    """Place of each unit in the order of folder, file and position."""
    parsed = units.parse_texts(_sources(spark, sf_dir)).select("rel_path", "pos", "unit_type", "name", "class_name", T.content_hash("content").alias("content_hash"))
    return units.placed(tables.materialize(parsed, "parsed")).select(F.col("seq").alias("unit_id"), F.col("rel_path").alias("path"), "unit_type", "name")


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that the lister and all executors see by the same path."""
    shared = tables.shared_dir(spark).removeprefix("file:")
    if not shared.startswith("/"):
        raise ValueError("files of a repository need a folder that is mounted on all machines as spark.checkpoint.dir")
    return f"/{shared.lstrip('/')}/codeloom-{uuid.uuid4().hex}"


def _written(root: str, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for row in part.itertuples(index=False):
            path = os.path.join(root, row.rel_path)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as file:
                file.write(row.content.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"n": [len(part)]})


def build_and_search(spark, sf_dir):
    """Files on disk, an index of them in a store, and the three units nearest to each benchmark text."""
    root = _shared_folder(spark)
    _sources(spark, sf_dir).mapInPandas(lambda it: _written(f"{root}/repo", it), "n long").agg(F.sum("n")).collect()
    os.makedirs(f"{root}/repo", exist_ok=True)
    build.build_index(spark, f"{root}/repo", f"{root}/store", embed.HashingEmbedder(DIMENSIONS), with_report=False)
    found = search.open_index(spark, f"{root}/store").search_all(_questions(spark, sf_dir), 3)
    return found.select("query_id", "rank", "path", "unit_type", "name", F.round("d2", 4).alias("d2"))


def build_report(spark, sf_dir):
    """Files, units and characters by extension and status, from the audit of a listing on disk."""
    root = _shared_folder(spark)
    _sources(spark, sf_dir).mapInPandas(lambda it: _written(root, it), "n long").agg(F.sum("n")).collect()
    files = build.scan(spark, root)
    audit = units.audit(files, units.parse(files.where("skip_reason is null")))
    return audit.groupBy("extension", "status", "error_type").agg(F.count("*").alias("files"), F.sum("n_units").alias("units"))


def catalog_reusable(spark, sf_dir):
    """The newest version of one repository at another commit: of the repository with most commits."""
    rows = _registry(spark, sf_dir)
    many = rows.where("commit is not null").groupBy("repo_name", "path_hash").agg(F.count_distinct("commit").alias("n"), F.min("commit").alias("commit"))
    one = many.orderBy(F.desc("n"), "repo_name", "path_hash").limit(1).collect()
    if not one:
        return rows.limit(0).select("repo_name", "index_name", "commit")
    return catalog.reusable(rows, one[0]["repo_name"], one[0]["path_hash"], one[0]["commit"]).select("repo_name", "index_name", "commit")


def stable_ids(spark, sf_dir):
    """Each document's place in the order of ids."""
    return batching.positions(_documents(spark, sf_dir).select("doc_id"), "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        knn_single, knn_batch, knn_filtered, units_by_type, units_by_language, corpus_totals, largest_units, content_hash_dedup, path_parts, skip_reason_counts, files_by_extension, token_estimate, sanitize_basic, sanitize_aggressive, prepare_text,
        truncate_unit, preview, batch_plan, stable_ids, cache_lookup, cache_merge, change_detection, change_counts, incremental_units, identity_dedup, vector_resize, hashed_embedding, text_search, catalog_latest, catalog_display, query_history, error_histogram, result_rows,
        ignored_paths, sanitize_extreme, code_units, code_unit_ids, catalog_reusable, build_and_search, build_report,
    )
}

def _quoted(body: str | None, mark: str = "") -> str:
    """SQL for a text of FILES or FOUND; mark cuts it as methods and functions are."""
    if body is None:
        return "NULL"
    out = "'" + body.replace("'", "''") + "'"
    for name, value in (("{d}", "d::VARCHAR"), ("{w}", "w"), ("{t}", "t")):
        out = f"replace({out}, '{name}', {value})" if name in body else out
    return f"(CASE WHEN length({out}) > {T.UNIT_CUT} THEN left({out}, {T.UNIT_CUT}) || '{mark}' ELSE {out} END)" if mark else out


def _found_sql() -> str:
    """The files of _sources, and the units that each must give."""
    rows = []
    for i, (letter, ext, _) in enumerate(FILES):
        for pos, kind, name, owner, content in FOUND[i]:
            cut = "... [content truncated]" if kind in ("method", "function") else ""
            error = "'SyntaxError'" if letter == "B" and kind is None else "NULL"
            rows.append(f"SELECT 'src/' || lang AS folder, 'src/' || lang || '/{letter}' || d || '{ext}' AS rel_path, {pos} AS pos, {_quoted(kind)} AS unit_type, {_quoted(name)} AS name, {_quoted(owner)} AS class_name, {_quoted(content, cut)} AS content, {error} AS error_type FROM docs WHERE d % {len(FILES)} = {i}")
    return f"docs AS (SELECT doc_id AS d, coalesce(lang, 'none') AS lang, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g') AS w, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(rows)})"


ORACLE_SQL: dict[str, str] = {
    "units_by_type": _by_sql("source"),
    "units_by_language": _by_sql("lang"),
    "corpus_totals": "SELECT count(*) AS n, sum(length(text))::BIGINT AS size FROM documents",
    "largest_units": f"SELECT doc_id, lang, source, length(text) AS size FROM documents ORDER BY size DESC, doc_id LIMIT {report.LARGEST}",
    "content_hash_dedup": "SELECT md5(text) AS content_hash, min(doc_id) AS first_seq, count(*) AS copies FROM documents GROUP BY 1",
    "path_parts": f"""SELECT doc_id, split_part(path, '/', -1) AS base, ext, replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '/', '.') AS package, CASE WHEN ext = '' THEN 'unknown' ELSE ext[2:] END AS language,
        CASE lower(split_part(path, '.', -1)) WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' WHEN 'xml' THEN 'xml' ELSE '' END AS highlight, path[6:] AS rel FROM ({PATHS_SQL})""",
    "skip_reason_counts": f"SELECT CASE WHEN ext IN ({', '.join(repr(e) for e in repository.BINARY)}) THEN 'binary' WHEN ext NOT IN ({', '.join(repr(e) for e in repository.SUPPORTED)}) THEN 'unsupported' ELSE 'parsed' END AS skip_reason, count(*) AS n FROM ({PATHS_SQL}) GROUP BY 1",
    "files_by_extension": f"SELECT ext AS extension, count(*) AS n FROM ({PATHS_SQL}) GROUP BY 1",
    "token_estimate": f"SELECT doc_id, {TOKENS_SQL.format(t='text')} AS tokens FROM documents",
    "sanitize_basic": f"SELECT doc_id, md5({CLEAN_SQL.format(t='text')}) AS clean FROM documents",
    "sanitize_aggressive": f"SELECT doc_id, md5(CASE WHEN {BLANK_SQL.format(t='a')} THEN '{T.EMPTY}' ELSE a END) AS clean FROM (SELECT doc_id, {ASCII_SQL.format(t=CLEAN_SQL.format(t='text'))} AS a FROM documents)",
    "prepare_text": f"""SELECT doc_id, md5(CASE WHEN {TOKENS_SQL.format(t='f')} <= {T.TOKENS_PER_TEXT} THEN f WHEN {BLANK_SQL.format(t='a')} THEN '{T.EMPTY}' ELSE a END) AS clean FROM (
        SELECT *, {ASCII_SQL.format(t='f')} AS a FROM (SELECT doc_id, CASE WHEN {BLANK_SQL.format(t='c')} THEN '{T.PLACEHOLDER}' ELSE c END AS f FROM (SELECT doc_id, {CLEAN_SQL.format(t=f'left(text, {T.TEXT_CUT})')} AS c FROM documents)))""",
    "truncate_unit": f"SELECT doc_id, md5(CASE WHEN length(text) > {T.UNIT_CUT} THEN left(text, {T.UNIT_CUT}) || '... [content truncated]' ELSE text END) AS cut FROM documents",
    "preview": f"SELECT doc_id, CASE WHEN length(text) > {T.PREVIEW_CONSOLE} THEN left(text, {T.PREVIEW_CONSOLE}) || '...' ELSE text END AS preview FROM documents",
    "batch_plan": f"""
        WITH p AS (SELECT doc_id, {TOKENS_SQL.format(t='text')} AS tokens, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
        b AS (SELECT *, pos // {batching.BATCH} AS batch FROM p),
        s AS (SELECT *, sum(tokens) OVER (PARTITION BY batch)::BIGINT AS total, count(*) OVER (PARTITION BY batch) AS n FROM b),
        c AS (SELECT *, (pos % {batching.BATCH}) // (CASE WHEN total > {batching.TOKENS_PER_BATCH} THEN greatest(1, n // (total // {batching.TOKENS_PER_BATCH} * 2 + 1)) ELSE n END) AS chunk FROM s),
        t AS (SELECT *, sum(tokens) OVER (PARTITION BY batch, chunk)::BIGINT AS chunk_tokens FROM c)
        SELECT doc_id, tokens, pos, batch, chunk, chunk_tokens, chunk_tokens > {T.TOKENS_PER_TEXT} AS single FROM t""",
    "ignored_paths": f"""SELECT doc_id, CASE WHEN regexp_matches(path, '(^|/)d17\\.py$') THEN false
        ELSE path LIKE '%/src1/%' OR path LIKE '%.tar.gz' OR path LIKE 'repo/src2/en/%' OR regexp_matches(path, '^repo/(.*/)?d[^/]*7\\.py$') END AS ignored FROM ({PATHS_SQL})""",
    "sanitize_extreme": f"""SELECT doc_id, md5(CASE WHEN c = '' THEN '{T.PLACEHOLDER}' ELSE c END) AS clean FROM (
        SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s\\p{{Z}}]', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS c FROM documents)""",
    "code_units": f"WITH {_found_sql()} SELECT rel_path, pos, unit_type, name, replace(folder, '/', '.') AS package, class_name, md5(content) AS content_hash, error_type FROM found",
    "code_unit_ids": f"WITH {_found_sql()} SELECT row_number() OVER (ORDER BY folder, rel_path, pos) - 1 AS unit_id, rel_path AS path, unit_type, name FROM found WHERE unit_type IS NOT NULL",
    "build_and_search": f"""WITH {_found_sql()}, own AS (SELECT *, row_number() OVER (ORDER BY folder, rel_path, pos) - 1 AS id, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM found WHERE unit_type IS NOT NULL),
        texts AS ({_prepared_sql("SELECT id, text FROM own UNION ALL SELECT -1 - item_id, text FROM benchmark")}), {HASHED_SQL}, {NEAREST_SQL}
        SELECT -1 - q AS query_id, rank, rel_path AS path, unit_type, name, d2 FROM nearest JOIN own USING (id) WHERE rank <= 3""",
    "build_report": f"""WITH {_found_sql()}, files AS (SELECT rel_path, count(unit_type) AS n, max(error_type) AS error_type FROM found GROUP BY rel_path)
        SELECT regexp_extract(rel_path, '[.][a-z]+$') AS extension, CASE WHEN error_type IS NULL THEN 'processed' ELSE 'error' END AS status, error_type, count(*) AS files, sum(n)::BIGINT AS units FROM files GROUP BY 1, 2, 3""",
    "catalog_reusable": f"""WITH {REGISTRY_SQL}, one AS (SELECT repo_name, path_hash, min(commit) AS commit FROM registry WHERE commit IS NOT NULL GROUP BY 1, 2 ORDER BY count(DISTINCT commit) DESC, repo_name, path_hash LIMIT 1)
        SELECT r.repo_name, index_name, r.commit FROM registry r JOIN one o ON r.repo_name = o.repo_name AND r.path_hash = o.path_hash AND r.commit <> o.commit ORDER BY indexed_on DESC, index_name LIMIT 1""",
    "stable_ids": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents",
    "cache_lookup": "WITH c AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT count(*) FILTER (h IS NOT NULL) AS hits, count(*) FILTER (h IS NULL) AS misses FROM documents LEFT JOIN c ON md5(text) = h",
    "cache_merge": "SELECT md5(text) AS content_hash, CASE WHEN bool_or(doc_id % 5 = 0) THEN 'new' WHEN bool_or(doc_id % 3 = 0) THEN 'shared' ELSE 'old' END AS origin FROM documents GROUP BY 1",
    "change_detection": f"WITH {LISTINGS_SQL} SELECT * FROM changed",
    "change_counts": f"WITH {LISTINGS_SQL} SELECT change, count(*) AS n FROM changed GROUP BY change",
    "incremental_units": f"""WITH {LISTINGS_SQL} SELECT rel_path AS path, 'kept' AS origin FROM old WHERE rel_path NOT IN (SELECT rel_path FROM changed WHERE change <> 'unchanged')
        UNION ALL SELECT rel_path, 'parsed' FROM changed WHERE change IN ('new', 'modified')""",
    "identity_dedup": """SELECT doc_id, lang, source, part, size FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY doc_id) AS i FROM (
        SELECT doc_id, lang, source, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 10 END AS part, length(text) AS size FROM documents)) WHERE i = 1""",
    "vector_resize": """SELECT vec_id, 48::INT AS size_48, 80::INT AS size_80, round(sqrt(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm_48,
        round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm_80 FROM embeddings""",
    "knn_single": f"SELECT rank, vec_id, round(d, 6) AS d2, round(1 / (1 + d), 6) AS score, lang, source FROM (SELECT *, row_number() OVER (ORDER BY d, vec_id)::INT AS rank FROM ({ONE_SQL}) ORDER BY d, vec_id LIMIT 10) JOIN documents ON doc_id = vec_id",
    "knn_batch": f"""SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round({D2_SQL.format(a='v.embedding', b='q.embedding')}, 6) AS d2, round(1 / (1 + {D2_SQL.format(a='v.embedding', b='q.embedding')}), 6) AS score,
        (row_number() OVER (PARTITION BY q.vec_id ORDER BY {D2_SQL.format(a='v.embedding', b='q.embedding')}, v.vec_id))::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 5""",
    "knn_filtered": f"SELECT vec_id, round(d, 6) AS d2, round(1 / (1 + d), 6) AS score, row_number() OVER (ORDER BY d, vec_id)::INT AS rank FROM (SELECT * FROM ({ONE_SQL}) WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY d, vec_id LIMIT 10)",
    "hashed_embedding": f"""WITH texts AS (SELECT doc_id AS id, text FROM documents), {HASHED_SQL}
        SELECT doc_id, string_agg(round(coalesce(x, 0)::DOUBLE * 10000)::BIGINT::VARCHAR, ',' ORDER BY places.i) AS vector
        FROM documents CROSS JOIN range({DIMENSIONS}) places(i) LEFT JOIN scaled s ON s.id = doc_id AND s.i = places.i GROUP BY doc_id""",
    "text_search": f"""WITH texts AS ({_prepared_sql("SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark")}), {HASHED_SQL}, {NEAREST_SQL}
        SELECT -1 - q AS query_id, rank, id AS unit_id, d2 FROM nearest WHERE rank <= 3""",
    "catalog_latest": f"WITH {REGISTRY_SQL} SELECT repo_name, path_hash, index_name, commit, is_modified FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, path_hash ORDER BY indexed_on DESC, index_name DESC) AS i FROM registry) WHERE i = 1",
    "catalog_display": f"""WITH {REGISTRY_SQL} SELECT repo_name AS name, repo_name || ' (' || path_hash || ')' || (CASE WHEN commit IS NULL THEN '' WHEN is_modified THEN ' @ ' || commit || ' (modified)' ELSE ' @ ' || left(commit, 8) END) AS full_name,
        left(commit, 8) || (CASE WHEN is_modified THEN ' (modified)' ELSE '' END) AS git_version, strftime(indexed_on, '%Y-%m-%dT%H:%M:%S') AS timestamp, index_name FROM registry""",
    "query_history": f"""SELECT query, ts.conv_id AS conv_id, ts.turn AS turn FROM (SELECT query, max(ts) AS ts FROM (SELECT lower(text) AS query, {{'conv_id': conv_id, 'turn': turn}} AS ts FROM conversations WHERE role = 'user')
        WHERE contains(query, 'a') GROUP BY query ORDER BY ts DESC, query LIMIT {history.KEEP})""",
    "error_histogram": "SELECT 'Error' || (user_id % 7) AS error_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "result_rows": f"""SELECT rank, vec_id, left(text, {T.PREVIEW_JSON}) AS content, source, printf('%.2f', round(1 / (1 + d), 6)) AS shown
        FROM (SELECT *, row_number() OVER (ORDER BY d, vec_id)::INT AS rank FROM ({ONE_SQL.replace('vec_id = 0', 'vec_id = 1')}) ORDER BY d, vec_id LIMIT 10) JOIN documents ON doc_id = vec_id""",
}
