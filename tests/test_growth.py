"""Steps whose work must not grow faster than their input."""

import os
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.extract import erlang, java, python
from codeloom.functions import tables
from codeloom.functions import text as T
from codeloom.operators import cache, catalog, embed, index, units
from codeloom.plans import build
from codeloom.plans import contract as C
from codeloom.streaming import files

WORDS = "word of a text, and " * 100_000


def _loop(text):
    """Seconds of a loop over the characters."""
    start, n = time.process_time(), 0
    for c in text:
        n += c in "([{"
    return time.process_time() - start


def _spent(work, text):
    start = time.process_time()
    found = work(text)
    return time.process_time() - start, found


def test_erlang_opaque_text_is_not_read_by_character():
    spent, found = _spent(erlang.units, f'f(X) -> "{WORDS}".\n%% {WORDS}\ng() -> ok.\n')
    assert [u[1] for u in found] == ["f", "g"] and spent < 2 * _loop(WORDS)


def test_java_opaque_text_is_not_read_by_character():
    body = f'class A {{\n  String s = """\n{WORDS}""";\n  // {WORDS}\n  int n() {{ return 1; }}\n}}\n'
    spent, found = _spent(java.units, body)
    assert [u[1] for u in found] == ["A", "n"] and spent < 4 * _loop(WORDS)
    assert [u[1] for u in java.units('class B { String s = """a\\""" + "}"; void m() { } }')] == ["B", "m"]


def test_python_lines_are_split_once():
    body = "".join(f"def f{i}(a, b=(1, 2)):\n    return 'é' * {i}\n\n" for i in range(400))
    spent, found = _spent(python.units, body + f'"""{WORDS}"""\n')
    assert len(found) == 400 and found[7][2] == "def f7(a, b=(1, 2)):\n    return 'é' * 7" and spent < 8 * _loop(WORDS)


def test_words_are_ascii_letters_digits_and_spaces(spark):
    text = "a-Z_09 é\n𝒳²٣\x00."
    df = spark.createDataFrame([(text,), (None,)], "text string")
    assert [r[0] for r in df.select(C.words()).collect()] == [re.sub("[^A-Za-z0-9 ]", " ", text), ""]


def test_sanitized_as_by_python(spark):
    every = "".join(f"a{chr(i)}" for i in [*range(0x100), *range(0x2000, 0x2070), 0xFEFF, 0xAD, 0x600, 0x1F600, 0xE0001])
    gone = {*range(0x200B, 0x2010), *range(0x202A, 0x202F), 0xFEFF}
    want = "".join(" " if ord(c) < 32 and c not in "\t\n\r" else c for c in every if ord(c) not in gone)
    assert spark.createDataFrame([(every,)], "t string").select(T.sanitize("t")).first()[0] == want


def test_hashed_words_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "A b, a é2"), (2, None), (3, "..")], "k long, t string")
    found = embed.HashingEmbedder(8).vectors(rows, "k", F.col("t"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.vector for r in found.collect()}
    assert got[2] == got[3] == [0.0] * 8 and np.allclose(got[1], embed.HashingEmbedder(8).embed_query("A b, a é2"))


def test_units_are_parsed_once_to_be_numbered(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(12)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, parse = spark.sparkContext.accumulator(0), units.parse_texts

    def counted(texts, **asked):
        def run(parts):
            for part in parts:
                seen.add(len(part))
                yield part

        return parse(texts.mapInPandas(run, texts.schema), **asked)

    monkeypatch.setattr(units, "parse_texts", counted)
    ids = sorted(r.unit_id for r in C.code_unit_ids(spark, str(tmp_path)).collect())
    assert ids == list(range(len(ids))) and len(ids) > 12 and seen.value == 12


def _bytes(path):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(path) for name in names)


def test_a_version_holds_contents_once(spark, tmp_path):
    """What a build leaves behind, in the store and beside it, of contents that don't compress much."""
    rng, root = random.Random(5), tmp_path / "repo"
    root.mkdir()
    body = lambda: "".join(chr(rng.randrange(0x4E00, 0x8E00)) for _ in range(60_000))
    for i in range(24):
        (root / f"f{i}.xml").write_text(body())
    shared = tables.shared_dir(spark).removeprefix("file:")
    before, size = _bytes(shared), _bytes(root)
    full = build.build_index(spark, str(root), str(tmp_path / "store"), with_report=False)
    assert _bytes(tmp_path / "store") + _bytes(shared) - before < 1.5 * size and full.units.count() == 24
    assert not os.path.exists(f"{full.location}/parsed") and not [t.name for t in spark.catalog.listTables() if t.name.startswith("codeloom_")]
    (root / "f3.xml").write_text(body())
    (root / "f4.xml").unlink()
    again = build.build_index(spark, str(root), str(tmp_path / "store"), incremental_build=True, with_report=False)
    assert _bytes(tmp_path / "store") + _bytes(shared) - before < 3 * size and again.units.count() == 23


def test_an_incremental_build_keeps_what_failed(spark, tmp_path):
    for name, body in {"a/bad.py": "def broken(:\n", "a/one.py": "def one(): pass\n\n\ndef two(): pass\n", "b.py": "def b(): pass\n", "gone.py": "def gone(:\n"}.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(body)
    root, store = str(tmp_path / "r"), str(tmp_path / "store")
    build.build_index(spark, root, store, with_report=False)
    (tmp_path / "r/gone.py").unlink()
    (tmp_path / "r/a/new.py").write_text("def new(): pass\n")
    build.build_index(spark, root, store, incremental_build=True, with_report=False)
    (tmp_path / "r/b.py").write_text("def b2(): return 22\n")
    again = build.build_index(spark, root, store, incremental_build=True, with_report=False)
    full = build.build_index(spark, root, str(tmp_path / "other"), with_report=False)
    assert sorted(map(str, again.units.collect())) == sorted(map(str, full.units.select(*again.units.columns).collect()))
    assert sorted(map(str, again.audit.collect())) == sorted(map(str, full.audit.collect())) and again.audit.where("error_type = 'SyntaxError'").count() == 1


def _moved(df):
    """Columns of the rows that are shuffled."""
    plan = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return set(re.findall(r"(\w+)#\d+", " ".join(re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan))))


def test_contents_are_not_shuffled_to_be_numbered_or_looked_up(spark, tmp_path):
    rows = spark.range(40_000).select(F.format_string("d%d/f%d.py", F.expr("id div 2 % 7"), F.expr("id div 2")).alias("rel_path"), (F.col("id") % 2).cast("int").alias("pos"), F.concat(F.lit("t"), F.col("id") % 900).alias("content"), F.col("id").cast("string").alias("name"), *[F.lit("file").alias(c) for c in ("unit_type", "package", "class_name")])
    parsed = tables.bucketed(rows, str(tmp_path / "parsed"), "rel_path")
    own = units.numbered(parsed)
    assert _moved(own) and "content" not in _moved(own)
    want = {r.name: r.seq for r in units.placed(parsed).collect()}
    own.write.parquet(str(tmp_path / "units"))
    own = spark.read.parquet(str(tmp_path / "units"))
    assert {r.name: r.seq for r in own.collect()} == want and sorted(want.values()) == list(range(40_000))
    known = own.where("content = 't7'").limit(1).select("content_hash", F.lit("m").alias("model"), F.lit(1).alias("dimensions"), F.lit(None).cast("array<float>").alias("vector"))
    known = spark.createDataFrame(known.collect(), schemas.CACHE)
    missed = cache.misses(own, known)
    assert "content" not in _moved(missed)
    assert sorted(r.content for r in missed.collect()) == sorted(f"t{i}" for i in range(900) if i != 7)


def test_buckets_lie_where_they_are_asked_for(spark, tmp_path):
    for path in (str(tmp_path / "a b%20c"), f"target-{tmp_path.name}"):
        rows = tables.bucketed(spark.range(50).withColumn("k", F.col("id") % 5), path, "k")
        assert rows.count() == spark.read.parquet(path).count() == 50 and "Exchange" not in rows.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def test_chosen_rows(spark, monkeypatch):
    rows = spark.range(100_000).select("id", F.lit("wide").alias("place"))
    keys = spark.createDataFrame([(i,) for i in (0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 99_999, 200_000, 8)], "id long")
    want = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 99_999]
    found = tables.chosen(rows, "id", keys)
    assert found.columns == rows.columns and sorted(r.id for r in found.collect()) == want
    monkeypatch.setattr(tables, "MASK_BYTES", 0)  # too many numbers for a mask
    assert sorted(r.id for r in tables.chosen(rows, "id", keys).collect()) == want
    assert tables.chosen(rows, "id", keys.limit(0)).count() == 0


def test_units_of_a_path_that_comes_twice_are_all_numbered(spark):
    parsed = units.parse_texts(spark.createDataFrame([("a/x.py", "def f(): pass\n"), ("a/x.py", "def g(): pass\n\n\ndef h(): pass\n"), ("b.xml", "<a/>")], "rel_path string, content string"))
    rows = units.numbered(tables.materialize(parsed, "parsed")).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(6)) and rows[0].path == "b.xml" and sorted(r.name for r in rows[1:]) == ["f", "g", "h", "x.py", "x.py"]


def test_ancestors_are_found_once_for_each_commit(spark, monkeypatch):
    written, write = [], catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, name: [out := write(df, name), written.append(out.count())][0])
    graph = spark.createDataFrame([(i, i - 1) for i in range(1, 17)], "commit long, parent long")
    indexed = spark.range(1).select(F.col("id").alias("commit"), F.current_timestamp().alias("indexed_on"))
    got = catalog.nearest_indexed(graph, indexed, graph.select("commit"))
    assert {r.commit: (r.ancestor, r.steps) for r in got.collect()} == {i: (0, i) for i in range(1, 17)}
    assert sum(written) < 16 * 16


def test_no_commit_is_its_own_ancestor(spark):
    graph = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("s", "s")], "commit string, parent string")
    indexed = spark.createDataFrame([("a", 2), ("e", 1), ("s", 3)], "commit string, day long").select("commit", F.timestamp_seconds("day").alias("indexed_on"))
    got = catalog.nearest_indexed(graph, indexed, graph.select("commit"))
    assert {r.commit: (r.ancestor, r.steps) for r in got.collect()} == {"a": ("e", 4), "b": ("a", 1), "c": ("e", 2), "d": ("e", 1)}


class _State:
    def __init__(self):
        self.value, self.calls = None, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "update":
                self.value = args[0]
            return {"get": self.value, "exists": self.value is not None, "listTimers": []}.get(name)

        return call


def test_a_path_costs_two_calls_for_its_state():
    import datetime

    from pyspark.sql import Row

    event = lambda day, deleted: Row(rel_path="a", mtime=1.0, size=1, event_time=datetime.datetime(2024, 1, day, tzinfo=datetime.timezone.utc), deleted=deleted, seq=day)
    tracker = files.Tracker()
    tracker.handle = tracker.state = both = _State()
    for rows, change, calls in (([event(2, False), event(1, True)], "new", ["get", "update"]), ([event(3, True)], "gone", ["get", "update", "registerTimer"]), ([event(1, False)], "gone", ["get", "update"]), ([event(4, False)], "new", ["get", "update", "deleteTimer"])):
        both.calls.clear()
        assert [r.change for r in tracker.handleInputRows(("a",), iter(rows), None)] == [change] and both.calls == calls


def test_many_queries_are_compared_in_little_memory():
    n, width = 20_000, 16
    numbers = np.random.default_rng(1).random((n + 3000, width)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(numbers[n:]), pa.list_(pa.float32()))], names=["k", "v"])
    ids, queries = pa.array(np.arange(n)), numbers[:n].astype(np.float64)
    tracemalloc.start()
    found = list(index._nearest((ids, queries), 3, "q", "k", iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    got = found[0].to_pydict()
    for q in (0, 777, n - 1):
        d = np.square(numbers[n:].astype(np.float64) - queries[q]).sum(axis=1)
        assert [k for k, own in zip(got["k"], got["q"]) if own == q] == list(np.argsort(d, kind="stable")[:3])
