import datetime
import json
import os
import random
import re
import shutil
import subprocess
import threading
import urllib.error
import urllib.request

import pytest

from codeloom import cli, schemas, server
from codeloom.operators import embed, metrics, report
from codeloom.operators import units as U
from codeloom.plans import build
from codeloom.plans import search as S
from codeloom.plans import store as store_module
from codeloom.plans.store import Conflict, Store
from codeloom.sources import git, repository
from codeloom.streaming import files as stream_files


def rows_of(df):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in df.drop("unit_id", "seq").collect())


def test_listing_and_reasons(spark, repo):
    files = {r.rel_path: r.skip_reason for r in build.scan(spark, str(repo)).collect()}
    assert {p for p, why in files.items() if why is None} == {"src/app/shapes.py", "src/app/__init__.py", "src/Parser.java", "src/top.py", "conf/a.xml", "broken.py", ".hidden.py", "_under.py", "latin.py"}
    assert {p: files[p] for p in ("run.log", "top.py", "docs/x/draft.xml", "logo.PNG", "notes.txt")} == {"run.log": "ignored", "top.py": "ignored", "docs/x/draft.xml": "ignored", "logo.PNG": "binary", "notes.txt": "unsupported"}
    assert not any(p.startswith(("build/", ".git/")) for p in files)
    assert {tuple(r) for r in repository.folders(spark, str(repo)).collect()} == {("build", "ignored"), (".git", "git"), ("lib/.git", "git")}
    every = {r.rel_path for r in repository.metadata(spark, str(repo)).collect()}
    assert {".git/config", "build/gen.py", "logo.PNG"} < every


@pytest.mark.parametrize("tasks", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("prune", [True, False])
def test_every_file_falls_to_one_task(tmp_path, tasks, prune):
    root = tmp_path / "wide"
    for path in [*(f"a/b{i}/c{j}/d/f{k}.py" for i in range(3) for j in range(i) for k in range(4)), *(f"flat/f{i}.py" for i in range(30)), *(f"many/m{i}/x.py" for i in range(20)), ".git/config", "a/.git/x", "out/gen.py", "top.py", "run.log"]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x")
    (root / "empty").mkdir()
    (root / ".gitignore").write_text("out/\n*.log\n")
    dealt = repository.parts(str(root), prune, tasks)
    assert 1 <= len(dealt) <= tasks
    assert len({p.folder for part in dealt for p in part if p.below}) <= max(1, tasks - 1)
    found = [row for part in dealt for p in part for row in repository.walk(str(root), prune, p)]
    own = {p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file()}
    hidden = {p for p in own if prune and (".git/" in p or p.startswith("out/"))}
    assert sorted(rel for rel, _, reason in found if reason is None) == sorted(own - hidden)
    assert sorted((rel, reason) for rel, _, reason in found if reason) == ([(".git", "git"), ("a/.git", "git"), ("out", "ignored")] if prune else [])
    assert [rel for rel, ignored, reason in found if reason is None and ignored and prune] == (["run.log"] if prune else [])


CONDITIONS = [
    "rel_path like 'src/app/%'", "rel_path like 'src/a%'", "rel_path = 'src/top.py'", "extension in ('.py', '.xml')", "extension = '.png'", "extension <> '.py'", "size > 10", "size >= 5 and size < 40", "size <= 0", "mtime > 1.5", "mtime < 0", "rel_path like '%.py' and not ignored",
    "rel_path like '%app%'", "ignored", "rel_path like 'no/such/%'", "rel_path like 'build/%'", "rel_path like 'lib/.git/%'", "rel_path = 'src'", "size is null", "size <> 3", "rel_path like 'src/%' and rel_path like 'src/app/s%' and size > 0", "extension in ('.py', null)", "size > 5 or ignored",
]


@pytest.mark.parametrize("prune", [True, False])
def test_conditions_act_while_walking(spark, repo, prune):
    every = repository._rows(spark, str(repo), prune)
    known = spark.createDataFrame(every.collect(), every.schema).cache()
    for condition in CONDITIONS:
        assert rows_of(every.where(condition)) == rows_of(known.where(condition)), condition


def test_a_prefix_opens_no_other_folder(repo, monkeypatch):
    opened, asked = [], []
    scandir, stat = os.scandir, os.stat
    monkeypatch.setattr(os, "scandir", lambda path=".": (opened.append(os.path.relpath(path, repo)), scandir(path))[1])
    reader = repository._Reader(str(repo), True, 4)
    left = list(reader.pushFilters([repository.StringStartsWith(("rel_path",), "src/app/sh"), repository.EqualTo(("extension",), ".py"), repository.EqualTo(("a", "b"), 1)]))
    assert len(left) == 1
    monkeypatch.setattr(os, "stat", lambda path, **kw: (asked.append(os.path.relpath(path, repo)), stat(path, **kw))[1])
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in rows] == ["src/app/shapes.py"] and set(opened) == {"src/app"}
    assert "src/app/__init__.py" not in asked


def test_plan_of_pushed_conditions(spark, repo):
    plan = repository.listing(spark, str(repo)).where("extension = '.py' and size > 10 and rel_path like 'src/%'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan repository" in plan and not re.search(r"\bFilter \(", plan), plan  # the lister has taken all of it over


def test_lister_of_no_files(spark, tmp_path):
    assert repository.listing(spark, str(tmp_path)).count() == repository.folders(spark, str(tmp_path)).count() == 0
    assert repository.listing(spark, str(tmp_path / "absent")).count() == 0


def test_parse_audit_and_report(spark, repo):
    files = build.scan(spark, str(repo))
    parsed = U.parse(files.where("skip_reason is null")).cache()
    own = U.numbered(parsed)
    rows = own.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    assert {(r.unit_type, r.name) for r in rows if r.path == "latin.py"} == {("file", "latin.py"), ("function", "cafe")}
    assert [r.content for r in rows if r.path == "conf/a.xml"] == ["<a>\n</a>"] and [r.package for r in rows if r.path == "conf/a.xml"] == ["conf"]
    assert {r.package for r in rows if r.path == "latin.py"} == {None}
    assert [r.unit_type for r in rows if r.path == "src/Parser.java"][0] == "class"
    audit = U.audit(files, parsed)
    counts = {(r.status, r.skip_reason): r.n for r in report.file_counts(audit).collect()}
    assert counts == {("processed", None): 8, ("error", None): 1, ("skipped", "ignored"): 3, ("skipped", "binary"): 1, ("skipped", "unsupported"): 2}
    assert {r.error_type: r.n for r in report.errors(audit).collect()} == {"SyntaxError": 1}
    (repo / "evil.py").write_text("def f():\n    return '<script>alert(1)</script>'\n")
    out = build.summary(spark, str(repo))
    page = report.as_html(out)
    assert "<script>" not in page and json.loads(report.as_json(out))["code_units"]["n"] == out["code_units"]["n"]
    assert out["folders"]["skipped"] == [".git", "build", "lib/.git"]


def opened(spark, store, entry):
    """The cache that a catalog row names."""
    return Store(spark, store).cache(int(entry["cache_ref"].rsplit("/", 1)[1].removesuffix(".json")))


def test_build_and_search(spark, repo, tmp_path):
    store = str(tmp_path / "store")
    built = build.build_index(spark, str(repo), store)
    assert built.vectors.count() == built.units.count() > 10
    assert built.report["code_units"]["n"] == built.units.count()
    assert built.report["file_processing"]["total"] == sum(r["n"] for r in built.report["file_processing"]["counts"])
    entry = build.list_indexes(spark, store).first()
    assert opened(spark, store, entry).count() == entry["cache_entries"] == built.units.select("content_hash").distinct().count()
    assert [r.value.split("\t")[0] for r in spark.read.text(build.write_index_list(spark, store)).collect()] == [entry["index_name"]]
    asked = spark.createDataFrame([(1, "def cafe return"), (2, "class Second"), (3, "def cafe return")], "query_id int, query string")
    engine = S.open_index(spark, store)
    many = {(r.query_id, r["rank"]): r.unit_id for r in engine.search_all(asked, 3).collect()}
    assert many == {(i, r["rank"]): r["unit_id"] for i, q in ((1, "def cafe return"), (2, "class Second"), (3, "def cafe return")) for r in engine.search(q, 3).collect()}
    hits = S.search(spark, store, "def cafe return", 3).collect()
    assert hits[0]["path"] == "latin.py" and [h["rank"] for h in hits] == [1, 2, 3] and all(0 < h["score"] <= 1 for h in hits)
    only = S.open_index(spark, store).search("def cafe", 100, where="unit_type = 'method'").collect()
    assert only and {h["unit_type"] for h in only} == {"method"}
    assert S.console_lines(S.search(spark, store, "cafe", 1)).first()["line"].startswith("1. ")
    with pytest.raises(LookupError):
        S.search(spark, store, "x", index_name="none")
    with pytest.raises(ValueError):
        S.search(spark, store, "")
    with pytest.raises(ValueError):
        S.search(spark, store, "x", embedder=embed.HashingEmbedder(7))


def test_incremental_build_equals_full_build(spark, repo, tmp_path):
    store = str(tmp_path / "store")
    first = build.build_index(spark, str(repo), store, with_report=False)
    before = {r.content_hash for r in first.units.collect()}
    (repo / "src/app/new.py").write_text("def fresh(): return 1\n")
    (repo / "src/top.py").write_text("def f(): return 22222\n")
    (repo / "broken.py").unlink()
    (repo / "latin.py").write_text("def whole(): pass\n")
    (repo / "src/notes.md").write_text("skip")
    again = build.build_index(spark, str(repo), store, incremental_build=True, with_report=False)
    full = build.build_index(spark, str(repo), str(tmp_path / "other"), with_report=False)
    assert rows_of(again.units) == rows_of(full.units)
    assert sorted(tuple(r) for r in again.units.select("unit_id", "path", "name").collect()) == sorted(tuple(r) for r in full.units.select("unit_id", "path", "name").collect())
    assert rows_of(again.audit.drop("path")) == rows_of(full.audit.drop("path"))
    embedded = {r.content_hash for r in spark.read.parquet(f"{again.location}/embedded").collect()}
    assert embedded and not embedded & before
    assert build.list_indexes(spark, store).count() == 1


def test_a_file_that_changes_while_it_is_indexed_is_new_to_the_next_build(spark, repo, tmp_path, monkeypatch):
    """Between the parse and the end of the build, and between the listing and the parse."""
    store, path = str(tmp_path / "store"), repo / "src/top.py"
    embedded, parsed = embed.embed_units, U.parse

    def then(*args, **kw):
        path.write_text("def late(): return 'after the parse'\n")
        return embedded(*args, **kw)

    monkeypatch.setattr(embed, "embed_units", then)
    first = build.build_index(spark, str(repo), store, with_report=False)
    assert first.units.where("path = 'src/top.py' and name = 'f'").count() == 1
    monkeypatch.setattr(embed, "embed_units", embedded)

    def before(*args, **kw):
        path.write_text("def later_still(): return 'before the parse'\n")
        return parsed(*args, **kw)

    monkeypatch.setattr(U, "parse", before)
    second = build.build_index(spark, str(repo), store, incremental_build=True, with_report=False)
    monkeypatch.setattr(U, "parse", parsed)
    third = build.build_index(spark, str(repo), store, incremental_build=True, with_report=False)
    full = build.build_index(spark, str(repo), str(tmp_path / "other"), with_report=False)
    assert second.units.where("path = 'src/top.py'").count() == 2
    assert rows_of(third.units) == rows_of(full.units)


def test_two_builders_lose_nothing(spark, repo, tmp_path):
    """Both at once, on one store; every version opens with the cache that it names."""
    store = str(tmp_path / "store")
    other = tmp_path / "other-repo"
    shutil.copytree(repo, other)
    (other / "own.py").write_text("def only_here(): return 'other'\n")
    found, errors = {}, []

    def builder(root):
        try:
            for turn in range(2):
                (root / f"turn{turn}.py").write_text(f"def turn_{turn}_of_{root.name.replace('-', '_')}(): pass\n")
                found[root.name, turn] = build.build_index(spark, str(root), store, with_report=False)
        except Exception as why:
            errors.append(why)

    threads = [threading.Thread(target=builder, args=(root,)) for root in (repo, other)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    place = Store(spark, store)
    rows = place.catalog().collect()
    assert len(rows) == 4 and {r["location"] for r in rows} == {b.location for b in found.values()}
    for row in rows:
        held = opened(spark, store, row)
        assert held.count() == row["cache_entries"] == held.select("content_hash").distinct().count()
        own = spark.read.parquet(f"{row['location']}/units")
        assert own.join(held, "content_hash", "left_anti").count() == 0
        assert spark.read.parquet(f"{row['location']}/vectors").count() == own.count() == row["n_units"]


def test_a_version_without_all_its_vectors_is_not_added(spark, repo, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    whole = embed.embed_units
    monkeypatch.setattr(embed, "embed_units", lambda *args: whole(*args).where("content_hash not like '0%' and content_hash not like '1%' and content_hash not like '2%'"))
    with pytest.raises(RuntimeError, match="vectors"):
        build.build_index(spark, str(repo), store, with_report=False)
    assert Store(spark, store).catalog().count() == 0 and Store(spark, store).cache().count() == 0
    monkeypatch.setattr(embed, "embed_units", whole)
    build.build_index(spark, str(repo), store, with_report=False)
    assert len(Store(spark, store).vacuum(older_than=-1)) == 2  # what the failed build had written
    assert S.search(spark, store, "cafe", 1).count() == 1


def test_failures_are_rows_and_are_never_cached(spark, repo, tmp_path):
    store, embedder = str(tmp_path / "store"), embed.RemoteEmbedder(Refuses, "refuses", 2)
    built = build.build_index(spark, str(repo), store, embedder, with_report=False)
    failed = spark.read.parquet(f"{built.location}/embedded").where("vector is null")
    assert failed.count() == 1 and failed.first()["status"].startswith("failed")
    assert built.vectors.count() == built.units.count() - 1
    assert Store(spark, store).cache().join(failed, "content_hash").count() == 0
    again = build.build_index(spark, str(repo), store, embedder, with_report=False)
    assert rows_of(spark.read.parquet(f"{again.location}/embedded").drop("vector")) == rows_of(failed.drop("vector"))


class Refuses:
    def __call__(self, texts):
        if any("cafe" in t for t in texts if "def" in t and "#" not in t):
            raise ValueError("$.input")
        return [[float(len(t)), 1.0] for t in texts]


def delta_rows(spark, rows):
    return spark.createDataFrame([(h, "m", 2, [float(x), 0.0]) for h, x in rows], schemas.CACHE)


def test_deltas_are_the_cache_that_merging_gives(spark, tmp_path, monkeypatch):
    """Any order of additions, tombstones and merges equals a plain dict; old commits open as they were."""
    monkeypatch.setattr(store_module, "SMALL", 8)
    place, want, seen, rng = Store(spark, str(tmp_path / "store")), {}, {}, random.Random(6)
    for turn in range(10):
        if turn % 5 == 4:
            gone = rng.sample(sorted(want), 3)
            number = place.forget(spark.createDataFrame([(h, "m", 2) for h in gone], "content_hash string, model string, dimensions int"))
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            new = {f"h{rng.randrange(40)}": turn for _ in range(6)}
            delta = place.write_delta(delta_rows(spark, new.items()))
            number = place.commit(lambda n, delta=delta: [store_module.added(delta, n)])
            want |= new
        seen[number] = dict(want)
        place.compact()
        assert {r.content_hash: r.vector[0] for r in place.cache().collect()} == want
    assert len(place.deltas()) < 7
    for number, then in list(seen.items())[::3]:
        assert {r.content_hash: r.vector[0] for r in place.cache(number).collect()} == then
    some = sorted(want)[:2]
    asked = place.cache(keys=spark.createDataFrame([(h,) for h in some], "content_hash string"))
    assert {r.content_hash for r in asked.collect()} == set(some)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (IN \(\d+,\d+\)|= \d+)", plan), plan  # only these buckets are read
    assert place.vacuum(older_than=-1)  # no version names a commit, so merged deltas go
    assert {r.content_hash: r.vector[0] for r in place.cache().collect()} == want


def test_a_build_writes_in_proportion_to_what_is_new(spark, tmp_path, monkeypatch):
    place, size = Store(spark, str(tmp_path / "store")), []
    monkeypatch.setattr(store_module, "FANOUT", 3)
    monkeypatch.setattr(store_module, "SMALL", 100)
    for turn in range(9):
        delta = place.write_delta(delta_rows(spark, [(f"{turn}-{i}", i) for i in range(50)]))
        place.commit(lambda n, delta=delta: [store_module.added(delta, n)])
        size.append(delta.rows)
        place.compact()
    assert size == [50] * 9 and place.cache().count() == 450
    written = sum(r["rows"] for r in place.actions().where("action = 'add'").select("rows").collect())
    assert written <= 450 * 4  # once, and once for each of a few sizes


def test_versions_pin_what_they_name(spark, repo, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FANOUT", 2)
    store = str(tmp_path / "store")
    place = Store(spark, store)
    for turn in range(4):
        (repo / f"turn{turn}.py").write_text(f"def turn{turn}(): pass\n")
        build.build_index(spark, str(repo), store, incremental_build=turn > 0, with_report=False)
    rows = place.catalog().orderBy("indexed_on").collect()
    place.vacuum(older_than=-1)
    for row in rows:
        assert opened(spark, store, row).count() == row["cache_entries"]
    place.drop_versions([r["location"] for r in rows[:3]])
    gone = place.vacuum(older_than=-1)
    assert {r["location"] for r in rows[:3]} <= set(gone) and any("/cache/" in path for path in gone)
    assert opened(spark, store, rows[3]).count() == rows[3]["cache_entries"]
    assert S.search(spark, store, "turn3", 1).first()["name"] == "turn3.py" and place.catalog().count() == 1


def test_a_number_is_given_once(spark, tmp_path):
    place = Store(spark, str(tmp_path / "store"))
    numbers, errors = [], []

    def writer(i):
        try:
            for k in range(5):
                numbers.append(place.commit(lambda n: [{"action": "add", "kind": "other", "path": f"{i}/{k}", "turn": n}]))
        except Exception as why:
            errors.append(why)

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(numbers) == list(range(20)) and place.live("other").count() == 20
    assert not place._made(place.commit_file(3), "again") and place.live("other").count() == 20
    with pytest.raises(Conflict):
        place.commit(lambda n: (_ for _ in ()).throw(Conflict("changed")))


def test_counts_taken_on_the_way_cost_no_job(spark, repo, tmp_path):
    built = build.build_index(spark, str(repo), str(tmp_path / "store"))
    dry = build.summary(spark, str(repo))
    assert {k: v for k, v in built.report.items() if k not in ("timestamp", "timings")} == {k: v for k, v in dry.items() if k not in ("timestamp", "timings")}

    def jobs(work):
        group = f"jobs-{random.random()}"
        spark.sparkContext.setJobGroup(group, group)
        work()
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    seen = metrics.Seen()
    spark.sparkContext.setJobGroup("write", "write")
    seen.files(built.audit).write.format("noop").mode("overwrite").save()
    seen.units(built.units).write.format("noop").mode("overwrite").save()
    assert jobs(lambda: (seen.file_counts(), seen.unit_counts(), seen["files"]["total"])) == 0
    assert seen.file_counts() == built.report["file_processing"]["counts"] and seen.unit_counts() == built.report["code_units"]["by_type"]
    folders = spark.createDataFrame([], schemas.FOLDERS)
    with_counts, without = (jobs(lambda: report.document("r", "t", {}, built.audit, folders, built.units, s)) for s in (seen, None))
    assert with_counts <= without - 4


def test_an_incremental_build_goes_on_from_the_nearest_ancestor(spark, repo, tmp_path):
    store, run = str(tmp_path / "store"), lambda *args: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)
    shutil.rmtree(repo / ".git")
    run("init", "-q", "-b", "main")

    def committed(name):
        (repo / f"{name}.py").write_text(f"def {name}(): pass\n")
        run("add", "-A")
        run("commit", "-q", "-m", name)

    committed("one")
    first = build.build_index(spark, str(repo), store, with_report=False)
    run("checkout", "-q", "-b", "side")
    committed("side")
    build.build_index(spark, str(repo), store, with_report=False)
    run("checkout", "-q", "main")
    committed("two")
    chosen = build._base(Store(spark, store).catalog(), str(repo))
    assert [r["location"] for r in chosen] == [first.location]
    again = build.build_index(spark, str(repo), store, incremental_build=True, with_report=False)
    assert rows_of(again.units) == rows_of(build.build_index(spark, str(repo), str(tmp_path / "other"), with_report=False).units)
    assert git.behind(str(repo), "0" * 40) is None and git.behind(str(repo), "HEAD") == 0


def test_empty_repository(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    built = build.build_index(spark, str(tmp_path / "empty"), str(tmp_path / "store"))
    assert built.units.count() == 0
    assert S.search(spark, str(tmp_path / "store"), "x").count() == 0


def test_git_versions(spark, repo, tmp_path):
    shutil.rmtree(repo / ".git")
    assert git.version(str(repo)) == (None, False)
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    run("add", "-A")
    run("commit", "-m", "x")
    commit, dirty = git.version(str(repo))
    assert len(commit) == 40 and not dirty
    clean = build.build_index(spark, str(repo), str(tmp_path / "store"), with_report=True)
    assert git.version(str(repo)) == (commit, False)
    (repo / "new.txt").write_text("x")
    changed = build.build_index(spark, str(repo), str(tmp_path / "store"), with_report=False)
    assert changed.index_name == clean.index_name + "-latest"


def test_cli(spark, repo, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    store = ["--store", str(tmp_path / "store")]
    assert cli.main(["--search", "x", *store]) == 1
    assert cli.main(["--index", "--dry-run", "--repo", str(repo), *store]) == 0
    assert "skipped (binary): 1 files" in capsys.readouterr().out and not (tmp_path / "store").exists()
    assert cli.main(["--index", "--repo", str(repo), *store]) == 0
    assert cli.main(["--list-indexes", *store]) == 0
    assert "my_repo" in capsys.readouterr().out
    assert cli.main(["--search", "def cafe", "--top-k", "2", *store]) == 0
    assert "latin.py" in capsys.readouterr().out
    answers = iter(["def cafe", "", "exit"])
    cli.interactive(spark, store[1], None, lambda _: next(answers))
    assert "10. " in capsys.readouterr().out


def test_server(spark, repo, tmp_path):
    store = str(tmp_path / "store")
    name = build.build_index(spark, str(repo), store, with_report=False).index_name
    up = threading.Event()
    held = {}

    def started(s):
        held["server"] = s
        up.set()

    threading.Thread(target=server.serve, args=(spark, store, "127.0.0.1", 0, started), daemon=True).start()
    assert up.wait(20)
    url = f"http://127.0.0.1:{held['server'].server_address[1]}"
    ask = lambda body: urllib.request.urlopen(urllib.request.Request(f"{url}/search", json.dumps(body).encode(), {"Content-Type": "application/json"}))
    assert b"<form" in urllib.request.urlopen(url).read()
    assert [r["index_name"] for r in json.load(urllib.request.urlopen(f"{url}/get_repositories"))] == [name]
    found = json.load(ask({"query": "def cafe return", "repository": name}))
    assert found[0]["path"] == "latin.py" and set(found[0]) >= {"path", "unit_type", "name", "content", "score"}
    for body, status in (({"query": ""}, 400), ({"query": "x", "repository": "none"}, 500)):
        with pytest.raises(urllib.error.HTTPError) as failed:
            ask(body)
        assert failed.value.code == status
    held["server"].shutdown()


def test_stream_of_file_events(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    lines = [{"rel_path": "a", "mtime": 1.0, "size": 1, "event_time": "2024-01-01T00:00:00Z", "deleted": False}, {"rel_path": "a", "mtime": 2.0, "size": 1, "event_time": "2024-01-01T00:01:00Z", "deleted": False}, {"rel_path": "b", "mtime": 1.0, "size": 1, "event_time": "2024-01-01T00:00:00Z", "deleted": True}]
    (folder / "1.json").write_text("\n".join(map(json.dumps, lines)))
    seen = []
    state = spark.createDataFrame([("b", 1.0, 1), ("c", 1.0, 1)], "rel_path string, mtime double, size long")

    def on_batch(batch, _):
        now, changed = stream_files.applied(state, batch)
        seen.append(({r.rel_path: r.mtime for r in now.collect()}, {r.rel_path: r.change for r in changed.collect()}))

    stream_files.follow(stream_files.events(spark, str(folder)), str(tmp_path / "cp"), on_batch).awaitTermination(60)
    assert seen == [({"a": 2.0, "c": 1.0}, {"a": "new", "b": "deleted", "c": "unchanged"})]
    assert stream_files.counts(stream_files.events(spark, str(folder))).isStreaming


def test_tracked_changes_whatever_the_order(spark, tmp_path):
    """Late and repeated events, a path that expires and comes back, and a restart between batches."""
    folder, out, checkpoint = tmp_path / "events", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    previous = spark.createDataFrame([("known", 1.0, 10), ("going", 2.0, 20), ("same", 3.0, 30), ("silent", 4.0, 40)], "rel_path string, mtime double, size long")
    batches = [
        [("known", 5.0, 11, 3, False), ("brief", 1.0, 1, 1, False), ("brief", None, None, 2, True), ("going", None, None, 5, True), ("same", 9.0, 9, 2, False), (None, 1.0, 1, 1, False)],
        [("known", 4.0, 12, 1, False), ("going", 2.0, 20, 4, False), ("same", 3.0, 30, 6, False), ("other", 1.0, 1, 40 * 24, False)],
        [("known", 7.0, 13, 40 * 24 + 2, False), ("other", 2.0, 1, 40 * 24 + 1, False)],
        [("brief", 8.0, 8, 40 * 24 + 3, False), ("stray", 1.0, 1, 40 * 24 - 20, False)],
    ]

    def run():
        stream = spark.readStream.schema(f"{stream_files.EVENTS}, seq long").option("maxFilesPerTrigger", 1).json(str(folder))
        stream_files.kept(stream_files.tracked(stream, previous, late="1 hour"), checkpoint, out).awaitTermination(240)

    number = 0
    for i, batch in enumerate(batches):
        lines = []
        for path, mtime, size, hour, deleted in batch:
            number += 1
            at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=hour)
            lines.append(json.dumps({"rel_path": path, "mtime": mtime, "size": size, "event_time": at.isoformat(), "deleted": deleted, "seq": number}))
        (folder / f"{i}.json").write_text("\n".join(lines))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        if i in (1, 3):  # the second run goes on where the first stopped
            run()
            rows = spark.read.parquet(out).collect()
            if i == 1:
                assert {(r.rel_path, r.n, r.change) for r in stream_files.latest_changes(spark, out).collect()} >= {("known", 2, "modified"), ("going", 2, "deleted"), ("same", 2, "unchanged"), ("other", 1, "new")}
    assert ("brief", "expired") in {(r.rel_path, r.change) for r in rows}
    got = {r.rel_path: (r.n, r.change, r.mtime, r.size) for r in stream_files.latest_changes(spark, out).collect()}
    assert got["known"] == (3, "modified", 7.0, 13) and got["going"][:2] == (2, "deleted") and got["same"] == (2, "unchanged", 3.0, 30) and got["other"] == (2, "new", 2.0, 1)
    assert "silent" not in got and None not in got
    assert ("brief", 1, "new") in {(r.rel_path, r.n, r.change) for r in rows if r.mtime == 8.0}  # its state was freed
    assert "stray" not in got  # later than the watermark allows


def client_of(key):
    def client(texts):
        assert key == "secret"
        return [[float(len(t)), 1.0] for t in texts]

    return client


def test_cli_takes_a_client(repo, tmp_path, capsys, spark):
    from codeloom import cli

    store, common = str(tmp_path / "store"), ["--client", "tests.test_build:client_of", "--api-key", "secret", "--dimensions", "2"]
    assert cli.main(["--index", "--repo", str(repo), "--store", store, "--no-report", *common]) == 0
    assert cli.main(["--search", "x" * 14, "--store", store, "--top-k", "1", *common]) == 0 and "1. " in capsys.readouterr().out
    assert cli.main(["--search", "x", "--store", store, *common[:2], "--api-key", ""]) == 1
