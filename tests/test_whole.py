"""Queries over whole tables, against plain Python."""

import hashlib
import re

import numpy as np
import pytest

from codeloom.operators import index
from codeloom.plans import contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def registry(spark):
    """index_name, repo_name, path_hash, commit, indexed_on of every event."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    return [(str(e.event_id), re.sub(r"[\W_]", "_", f"{e.event_type}-{e.user_id % 50}"), md5(f"/src/{e.event_type}")[:8], md5(str(e.event_id)) if e.event_id % 4 else None, e.ts) for e in events]


def test_every_event_is_a_registry_row(spark, registry):
    shown = contract.catalog_display(spark, SF).collect()
    assert sorted(r.index_name for r in shown) == sorted(x[0] for x in registry)
    newest = {}
    for name, repo, path, _, ts in registry:
        newest[repo, path] = max(newest.get((repo, path), (ts, name)), (ts, name))
    assert {(r.repo_name, r.path_hash): r.index_name for r in contract.catalog_latest(spark, SF).collect()} == {k: name for k, (_, name) in newest.items()}
    commits = {}
    for x in registry:
        if x[3]:
            commits.setdefault(x[1:3], set()).add(x[3])
    most = min(commits, key=lambda k: (-len(commits[k]), k))  # the repository with most commits
    one = (*most, min(commits[most]))
    others = [x for x in registry if x[1:3] == one[:2] and x[3] and x[3] != one[2]]
    last = max(x[4] for x in others)
    want = min(x[0] for x in others if x[4] == last)
    assert [(r.repo_name, r.index_name) for r in contract.catalog_reusable(spark, SF).collect()] == [(one[0], want)]


def test_every_hundredth_vector_asks_all(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.integers(-3, 4, (450, 6)).astype(float)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for q in range(0, len(points), 100):
        d = np.square(points - points[q]).sum(axis=1)
        want |= {(q, rank): (i, d[i]) for rank, i in enumerate(np.lexsort((np.arange(len(d)), d))[:5].tolist(), 1)}
    for limit in (index.QUERY_BYTES, 2 * 6 * 8):  # one block of queries, and three
        monkeypatch.setattr(index, "QUERY_BYTES", limit)
        got = contract.knn_batch(spark, str(tmp_path)).collect()
        assert len(got) == len(want) and {(r.query_id, r["rank"]): (r.vec_id, r.d2) for r in got} == want


def test_queries_are_whole_turns(spark):
    last = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user' and text is not null").collect():
        if "a" in r.text.lower():
            last[r.text.lower()] = max(last.get(r.text.lower(), (-1, -1)), (r.conv_id, r.turn))
    want = sorted(last.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:10]
    assert [(r.query, (r.conv_id, r.turn)) for r in contract.query_history(spark, SF).collect()] == want


def test_merged_caches_cover_all_documents(spark):
    want = {}
    for n, name in ((1, "old"), (3, "shared"), (5, "new")):
        for r in spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id % {n} = 0").collect():
            want[hashlib.md5(r.text.encode()).hexdigest()] = name
    got = contract.cache_merge(spark, SF).collect()
    assert len(got) == len(want) and {r.content_hash: r.origin for r in got} == want
