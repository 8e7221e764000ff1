import collections
import datetime
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import batching, cache, catalog, cells, embed, history, incremental, index, report
from codeloom import schemas


def test_knn_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = np.round(rng.normal(size=(300, 8)), 1).astype("float32")
    data[50:60] = data[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(999, None), (998, [1.0])], "unit_id long, vector array<float>").repartition(3)
    asked = [data[0], data[7] + 0.1]
    want = [sorted((float(((v.astype(float) - q.astype(float)) ** 2).sum()), i) for i, v in enumerate(data))[:12] for q in asked]
    for q, w in zip(asked, want):
        got = index.knn(rows, q.tolist(), 12).orderBy("rank").collect()
        assert [r.unit_id for r in got] == [i for _, i in w] and [r.rank for r in got] == list(range(1, 13))
        assert all(0 < r.score <= 1 and r.d2 == pytest.approx(d, abs=1e-5) for r, (d, _) in zip(got, w))
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)] + [(5, None)], "query_id long, query_vector array<float>")
    for size, block in ((index.QUERY_BYTES, index.VECTOR_BYTES), (64, 5000)):  # sent to all tasks, and a grid of 2 by 4 blocks
        monkeypatch.setattr(index, "QUERY_BYTES", size)
        monkeypatch.setattr(index, "VECTOR_BYTES", block)
        got = {(r.query_id, r["rank"]): r.unit_id for r in index.knn_batch(rows, queries, 12).collect()}
        assert got == {(q, n + 1): i for q, w in enumerate(want) for n, (_, i) in enumerate(w)}
    assert index.knn(rows, asked[0].tolist(), 1000).count() == 300
    assert index.knn_batch(rows, queries.limit(0), 3).count() == 0 and index.knn_batch(rows.limit(0), queries, 3).count() == 0


def test_knn_reads_only_keys_and_vectors(spark):
    plan = index.knn(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), [0.0] * 64, key="vec_id", vector="embedding")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan


def test_known_scores(spark):
    rows = spark.createDataFrame([(1, [0.8] * 384), (2, [0.2] * 384)], "unit_id long, vector array<float>")
    assert [round(r.score, 6) for r in index.knn(rows, [0.75] * 384, 2).orderBy("rank").collect()] == [0.510204, 0.008535]


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i * 7 - 3000, rng.choice([0, 10, 200, 2500, 9000])) for i in range(1234)]
    got = sorted(batching.plan(spark.createDataFrame(rows, "k long, t long").repartition(5), "k", "t").collect(), key=lambda r: r.k)
    want = []
    for b in range(0, len(rows), 100):
        part = rows[b : b + 100]
        total = sum(t for _, t in part)
        size = len(part) if total <= 6000 else max(1, len(part) // (total // 6000 * 2 + 1))
        for i, (k, _) in enumerate(part):
            chunk = part[i // size * size : i // size * size + size]
            want.append((k, b + i, b // 100, i // size, sum(t for _, t in chunk) > 8000))
    assert [(r.k, r.pos, r.batch, r.chunk, r.single) for r in got] == want


@pytest.mark.parametrize("block", [7, 10_000])
def test_positions_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(batching, "BLOCK", block)
    rng = random.Random(4)
    keys = rng.sample(range(-(10**15), 10**15), 300) + [None]
    got = batching.positions(spark.createDataFrame([(k,) for k in keys], "k long").repartition(4), "k").collect()
    assert {r.k: r.pos for r in got} == {k: i for i, k in enumerate(sorted(keys, key=lambda k: (k is not None, k or 0)))}
    names = [(f"{rng.choice('abé')}/{i % 40}", n) for i in range(200) for n in range(3)]
    rows = spark.createDataFrame(sorted({(a, b) for a, b in names}), "name string, n int").repartition(3)
    assert [(r["name"], r.n) for r in sorted(batching.positions(rows, "name", "at", ("n",)).collect(), key=lambda r: r.at)] == sorted({(a, b) for a, b in names})
    assert batching.positions(rows.limit(0), "name").count() == 0


def test_positions_of_hot_values_and_clashing_names(spark, monkeypatch):
    """Equal values are dealt to several ranges, and no column of the caller's is lost."""
    monkeypatch.setattr(batching, "BLOCK", 50)
    rows = spark.createDataFrame([(1, i) for i in range(400)] + [(0, -1), (2, -2)], "k int, v int")
    for name in ("tie", "index", "block", "before", "n", "total", "size"):
        rows = rows.withColumn(name, F.col("v"))
    out = batching.positions(rows.repartition(3), "k")
    assert set(out.columns) == {*rows.columns, "pos"}
    got = out.collect()
    assert sorted(r.pos for r in got) == list(range(402)) and {r.pos: r.k for r in got}[0] == 0 and {r.pos: r.k for r in got}[401] == 2
    assert all(r.block == r.v == r.n for r in got)
    sizes = [spark.read.parquet(f).count() for f in out.inputFiles()]
    assert len([n for n in sizes if n > 1]) > 4 and max(sizes) < 200
    plan = batching.plan(rows.withColumn("t", F.lit(1)), "k", "t")
    assert {*rows.columns, "pos", "batch", "chunk", "single"} <= set(plan.columns)


def units(spark, contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "seq long, content string").withColumn("unit_id", F.col("seq")).withColumn("content_hash", T.content_hash("content"))


def test_cells_find_what_the_flat_index_finds(spark, tmp_path, monkeypatch):
    """Recall is as wanted, all vectors are reachable, and a hot cell is dealt to several tasks."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    points = np.concatenate([(centres[rng.integers(30, size=1500)] + 0.3 * rng.normal(size=(1500, 16))), np.tile(rng.normal(size=16), (600, 1))]).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(9001, None), (9002, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "unit_id long, vector array<float>").repartition(5)
    queries = vectors.where("unit_id % 50 = 0 and size(vector) = 16").selectExpr("unit_id as query_id", "vector as query_vector")
    book = cells.learn(vectors, 10)
    assert 1 <= book.probes < len(book.centres) == 45
    held = cells.assigned(vectors, book).cache()
    assert held.count() == 2100 and held.select("unit_id").distinct().count() == 2100
    exact = index.knn_batch(vectors, queries, 10)
    few = cells.knn_batch(held, book, queries, 10)
    assert cells.recall(few, exact).agg(F.avg("recall")).first()[0] >= 0.9
    same = lambda df: sorted((r.query_id, r["rank"], r.unit_id, round(r.d2, 6)) for r in df.collect())
    monkeypatch.setattr(cells, "ROWS", 70)
    monkeypatch.setattr(cells, "QUERIES", 3)
    assert same(cells.knn_batch(held, book, queries, 10, probes=len(book.centres))) == same(exact)
    assert same(cells.knn_batch(held, book, queries, 10)) == same(few)
    cells.write_cells(vectors, book, str(tmp_path / "cells"))
    written = spark.read.schema("unit_id long, vector array<float>, cell int").parquet(str(tmp_path / "cells"))
    one = cells.knn(written, book, points[3].tolist(), 10, probes=2)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().executedPlan().toString() and one.orderBy("rank").first()["unit_id"] == 3
    nothing = cells.learn(vectors.limit(0), 3)
    assert cells.knn_batch(held, nothing, queries, 3).count() == 0 and cells.assigned(vectors, nothing).count() == 0


def test_queries_of_several_lengths_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "unit_id long, vector array<float>")
    with pytest.raises(ValueError, match="1 to 2"):
        index.knn_batch(rows, spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id long, query_vector array<float>"))


def plain_changes(now, was):
    """The same by lists: what both have, then by identity, then by content."""
    same = collections.Counter(now) & collections.Counter(was)
    plus, minus, out = collections.Counter(now) - same, collections.Counter(was) - same, collections.Counter()
    out.update({(u, "unchanged"): n for u, n in same.items()})
    order = lambda x: (x is not None, x or "")
    for by, sort, kind in ((lambda u: u[:-1], lambda u: u[-1], "changed"), (lambda u: u[-1], lambda u: [order(x) for x in u[:-1]], "moved")):
        for group in {by(u) for u in plus} & {by(u) for u in minus}:
            sides = [[u for u in sorted((u for u in side if by(u) == group), key=sort) for _ in range(side[u])] for side in (plus, minus)]
            n = min(map(len, sides))
            out.update(((u, kind) for u in sides[0][:n]))
            plus -= collections.Counter(sides[0][:n])
            minus -= collections.Counter(sides[1][:n])
    out.update({(u, "new"): n for u, n in plus.items()})
    out.update({(u, "gone"): n for u, n in minus.items()})
    return {k: n for k, n in out.items() if n}


@pytest.mark.parametrize("block", [9, 100_000])
def test_unit_changes_by_lists(spark, monkeypatch, block):
    monkeypatch.setattr(batching, "BLOCK", block)
    rng = random.Random(7)
    unit = lambda: (rng.choice("abcdef"), rng.choice(["n", "m"]), "file", rng.choice([None, "p", ""]), None, rng.choice("xyzwv"))
    schema = "path string, name string, unit_type string, package string, class_name string, content_hash string"
    now, was = [unit() for _ in range(150)], [unit() for _ in range(130)]
    now += [("hot", "n", "file", None, None, "x")] * 90 + [("new", "n", "file", None, None, "x")] * 30
    was += [("hot", "n", "file", None, None, "y")] * 50 + [("old", "n", "file", None, None, "x")] * 70
    got = incremental.unit_changes(spark.createDataFrame(now, schema).repartition(3), spark.createDataFrame(was, schema).repartition(4)).collect()
    assert {(tuple(r)[:6], r.change): r.n for r in got} == plain_changes(now, was)
    assert incremental.unit_changes(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(batching, "BLOCK", 10)
    rows = [(i % 4, i, i % 3) for i in range(95)]
    got = batching.running(spark.createDataFrame(rows, "k int, i int, v int").repartition(3), ["k", "i"], {"v": "before"}).collect()
    total, want = 0, {}
    for k, i, v in sorted(rows):
        want[k, i] = total
        total += v
    assert {(r.k, r.i): r.before for r in got} == want


def test_nearest_indexed_ancestor(spark):
    edges = [("c", "b"), ("b", "a"), ("m", "c"), ("m", "x"), ("x", "y"), ("y", "a"), ("lone", None), ("loop1", "loop2"), ("loop2", "loop1")]
    t = lambda day: datetime.datetime(2024, 1, day)
    indexed = [("a", t(1)), ("x", t(2)), ("c", t(3)), ("c", t(1)), ("m", t(9))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = frame([(x,) for x in ("m", "c", "x", "a", "lone", "loop1", "none", None, "m")], "commit string")
    got = catalog.nearest_indexed(frame(edges, "commit string, parent string"), frame(indexed, "commit string, indexed_on timestamp"), asked)
    assert {r.commit: (r.ancestor, r.steps) for r in got.collect()} == {"m": ("c", 1), "c": ("a", 2), "x": ("a", 2)}
    assert catalog.nearest_indexed(frame([], "commit string, parent string"), frame(indexed, "commit string, indexed_on timestamp"), asked).count() == 0


def test_rolled_up_with_the_largest(spark):
    rows = [("py", None, 5, 1), ("py", None, 9, 2), ("py", "file", 9, 3), ("xml", "file", 1, 4), (None, "file", 9, 5), ("py", "file", 7, 6), ("py", "file", 7, 7)]
    df = spark.createDataFrame(rows, "language string, unit_type string, size int, seq int").repartition(3)
    got = {(r.language, r.unit_type, r.level): (r.n, r["size"], [(x["at"], x["size"]) for x in r.top], r.more) for r in report.rolled(df, ["language", "unit_type"], 2).collect()}
    assert got == {
        ("py", None, 0): (2, 14, [(2, 9), (1, 5)], 0), ("py", "file", 0): (3, 23, [(3, 9), (6, 7)], 1), ("xml", "file", 0): (1, 1, [(4, 1)], 0), (None, "file", 0): (1, 9, [(5, 9)], 0),
        ("py", None, 1): (5, 37, [(2, 9), (3, 9)], 3), ("xml", None, 1): (1, 1, [(4, 1)], 0), (None, None, 1): (1, 9, [(5, 9)], 0), (None, None, 3): (7, 47, [(2, 9), (3, 9)], 5),
    }
    assert "WindowGroupLimit" in report.rolled(df, ["language", "unit_type"], 2)._jdf.queryExecution().executedPlan().toString()


class Client:
    def __init__(self, refuse=(), fail=0):
        self.refuse, self.fail, self.calls = refuse, fail, []

    def __call__(self, texts):
        self.calls.append(list(texts))
        if self.fail:
            self.fail -= 1
            raise OSError("busy")
        for t in texts:
            if any(x in t for x in self.refuse):
                raise ValueError("$.input is invalid")
        return [[float(len(t)), 1.0] for t in texts]


def test_merged_caches_keep_columns_of_any_name(spark):
    one = spark.createDataFrame([("a", 1, 2)], "content_hash string, turn int, row int")
    assert [tuple(r) for r in cache.merge(one, one.withColumn("turn", F.lit(5)), key=["content_hash"]).collect()] == [("a", 5, 2)]
    assert [tuple(r) for r in cache.identity_dedup(one.unionByName(one), ["content_hash"], order="turn").collect()] == [("a", 1, 2)]


def test_only_misses_are_embedded_and_each_content_once(spark):
    rows = units(spark, ["a", "bb", "a", "ccc", "bb"])
    embedder = embed.RemoteEmbedder(Client, "m", 2)
    empty = spark.createDataFrame([], schemas.CACHE)
    first = embed.embed_units(rows, embedder, empty)
    assert sorted(tuple(r.vector) for r in first.collect()) == [(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)]
    known = first.where("content_hash = md5('a')").select(*empty.columns)
    assert embed.embed_units(rows, embedder, known).count() == 2
    assert embed.embed_units(rows, embed.RemoteEmbedder(Client, "other", 2), known).count() == 3
    assert cache.hit_counts(cache.lookup(rows, known)).first()[:] == (2, 3)


def test_calls_in_flight_are_bounded_and_in_order():
    running, most, begun, lock = 0, 0, 0, threading.Lock()

    def jobs():
        nonlocal begun
        for i in range(60):
            begun += 1
            yield i

    def work(i):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.002 * (i % 5))
        with lock:
            running -= 1
        return i

    ahead = []
    for i, got in enumerate(embed.in_order(work, jobs(), 4)):
        assert got == i
        ahead.append(begun - i)
    assert 2 <= most <= 4 and max(ahead) <= 5
    with pytest.raises(ZeroDivisionError):
        list(embed.in_order(lambda i: 1 // (i - 3), range(9), 2))


def test_waits_as_asked(monkeypatch):
    waits = []
    monkeypatch.setattr(embed.time, "sleep", waits.append)
    turns = iter([embed.Busy(after=7.0), OSError(), OSError(), embed.Busy(after=99.0)])

    def client(texts):
        for why in turns:
            raise why
        return [[1.0]] * len(texts)

    ladder = embed.Ladder(client, embed.Calls(retries=4, wait=0.5, longest=30))
    assert ladder.chunk(["x", "y"]) == [([1.0], "ok")] * 2
    assert waits == [7.0, 1.0, 2.0, 30] and ladder.asked == 1


def test_rows_that_failed_have_a_status_and_answers_are_by_key(spark):
    rows = spark.createDataFrame([(i, "bad" if i % 50 == 7 else f"text {i}") for i in range(450)], "id long, content string").repartition(7)
    got = {r.id: r for r in embed.RemoteEmbedder(lambda: Client(refuse=["bad"]), "m", 3).answers(rows, "id", F.col("content")).collect()}
    assert len(got) == 450 and all((r.vector is None) == (i % 50 == 7) for i, r in got.items())
    assert all(list(r.vector) == [len(f"text {i}"), 1, 0] for i, r in got.items() if r.vector)
    assert {(r.batch, r.chunk) for r in got.values()} == {(b, 0) for b in range(5)} and {r.asked for r in got.values()} <= {2 + 98 + 2 * 3, 2 + 49 + 3}


def test_ladder():
    client = Client(refuse=["é"])
    assert embed.called(client, ["x", "é"]) == [([1.0, 1.0], "plain"), ([13.0, 1.0], "plain")]
    client = Client(refuse=["+"])
    assert embed.called(client, ["x", "a+b"]) == [([1.0, 1.0], "ok"), ([3.0, 1.0], "plainest")]
    client = Client(refuse=["bad"])
    got = embed.called(client, ["bad", "good"])
    assert got[0][0] is None and got[0][1].startswith("failed") and got[1] == ([4.0, 1.0], "ok")
    assert embed.called(Client(fail=2), ["x"]) == [([1.0, 1.0], "ok")]
    with pytest.raises(OSError):
        embed.called(Client(fail=9), ["x"])


def test_failures_are_rows_without_vector_and_not_indexed(spark):
    rows = units(spark, ["fine", "bad one"])

    def make():
        return Client(refuse=["bad"])

    out = embed.embed_units(rows, embed.RemoteEmbedder(make, "m", 3), spark.createDataFrame([], schemas.CACHE))
    assert {(r.vector is None, r.status[:6]) for r in out.collect()} == {(False, "ok"), (True, "failed")}
    assert [tuple(r) for r in index.build_vectors(rows, out, 3).collect()] == [(0, [4.0, 1.0, 0.0])]


def test_hashing_embedder_of_columns_and_queries_agree(spark):
    e = embed.HashingEmbedder(16)
    for text in ("parse the erlang file", "", "é!", "A a b"):
        got = e.vectors(spark.createDataFrame([(1, text)], "k int, t string"), "k", F.col("t")).first()["vector"]
        assert got == pytest.approx(e.embed_query(text), abs=1e-6)


def test_cache_merge_later_wins(spark):
    make = lambda rows: spark.createDataFrame([(h, "m", 1, [v]) for h, v in rows], schemas.CACHE)
    got = cache.merge(make([("a", 1.0), ("b", 1.0)]), make([("b", 2.0)]), make([("c", 3.0), ("a", 3.0)]))
    assert {r.content_hash: r.vector[0] for r in got.collect()} == {"a": 3.0, "b": 2.0, "c": 3.0}


def test_identity_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([(2, "p", "f", None), (1, "p", "f", None), (3, "p", "f", "C")], "seq long, path string, name string, class_name string")
    assert sorted(r.seq for r in cache.identity_dedup(rows, ["path", "name", "class_name"]).collect()) == [1, 3]


def test_changes(spark):
    make = lambda rows: spark.createDataFrame(rows, schemas.FILE_META)
    changed = incremental.changes(make([("a", 1.0, 1), ("b", 2.0, 1), ("c", 1.0, 2), ("d", None, 1)]), make([("b", 1.0, 1), ("c", 1.0, 2), ("a/b.py", 1.0, 1), ("d", None, 1)]))
    assert {r.rel_path: r.change for r in changed.collect()} == {"a": "new", "b": "modified", "c": "unchanged", "a/b.py": "deleted", "d": "unchanged"}
    old = spark.createDataFrame([("a/b.py",), ("a/b.pyx",), ("b",)], "path string")
    assert [r.path for r in incremental.kept_units(old, changed).collect()] == ["a/b.pyx"]


def test_history(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([(f"q{i}", at(i)) for i in range(15)] + [("q3", at(50)), (None, at(55))], schemas.HISTORY)
    assert [r.query for r in history.latest(rows).collect()] == ["q3", *[f"q{i}" for i in range(14, 5, -1)]]
    assert history.record(rows, spark.createDataFrame([("Q0", at(59))], schemas.HISTORY)).first()["query"] == "Q0"
    assert {r.query for r in history.matching(rows, "Q1").collect()} == {"q1", *[f"q{i}" for i in range(10, 15)]}


def test_catalog(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    row = lambda name, commit, dirty, s: (name, "r", "h", commit, dirty, "/r", at(s), 1, 2, False, "m", "l", None, 0)
    rows = spark.createDataFrame([row("a", "c1", False, 1), row("b", "c2", True, 2), row("c", None, False, 3)], schemas.CATALOG)
    assert catalog.reusable(rows, "r", "h", "c2").first()["index_name"] == "a"
    assert catalog.reusable(rows, "r", "h", None).count() == 0
    assert [r.git_version for r in catalog.displayed(catalog.newest_first(rows)).collect()] == [None, "c2 (modified)", "c1"]
    assert catalog.latest_by_repository(rows).first()["index_name"] == "c"
