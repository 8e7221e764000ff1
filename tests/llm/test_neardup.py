"""Shingles, fingerprints, near duplicates and the pipeline against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import bpe, fingerprints, langid, neardup, queries, secretscan
from codeloom.llm import shingles as S

from .conftest import odd_texts
from .test_text import plain_lines
from .test_tokens import check_packing


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    """texts: doc_id to text."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    holds = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holds[x].add(i)
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in sets.items():
        for j, both in collections.Counter(j for x in s for j in holds[x] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_shingle_sets_are_those_of_the_words():
    for text in odd_texts():
        assert len(S.shingle_set(text or "")) == len(plain_set(text))
    assert (S.shingle_set("A b\tc  d\ne f") == S.shingle_set("a B c d e F")).all()
    assert S.digest(S.shingle_set("a b c d e")) != S.digest(S.shingle_set("a b c d e f"))
    assert len(S.shingle_set("word " * 5 + "z")) == 2 and len(S.shingle_set("ab c")) == 1 and S.shingle_set("ab c")[0] != S.shingle_set("a bc")[0]


def test_mask_lets_all_wanted_rows_through(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("if(id = 7, null, id) as doc_id", "id * 3 as text_key", "'clash' as word", "'clash' as bits")
    wanted = rows.where("text_key % 7 = 0").selectExpr("doc_id as at_id", "text_key as at_key")
    for bits in (neardup.MASK_BITS, 64):
        monkeypatch.setattr(neardup, "MASK_BITS", bits)
        through = neardup.masked(rows, wanted, ["doc_id", "text_key"], ["at_id", "at_key"])
        assert through.columns == rows.columns
        keys = [r["text_key"] for r in through.collect()]
        assert len(keys) == len(set(keys)) and {k for k in range(0, 15000, 3) if k % 7 == 0} <= set(keys)
    monkeypatch.undo()
    assert neardup.masked(rows, wanted, ["doc_id", "text_key"], ["at_id", "at_key"]).count() < 1000
    assert not neardup.masked(rows, wanted.limit(0), ["doc_id", "text_key"], ["at_id", "at_key"]).count()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(1 << 63, size=3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:])
    both, union = S.jaccard(a, b)
    assert (both, union) == (1500, 3000)
    assert abs((S.signature(a, 2048) == S.signature(b, 2048)).mean() - 0.5) < 0.05
    own = np.stack([S.marks(S.signature(a))] * 2)
    assert S.bands(own, 4).shape == (2, 32) and (S.bands(own, 4)[0] == S.bands(own, 4)[1]).all() and len(np.unique(S.bands(own, 4))) == 32


@pytest.mark.parametrize("n", [200, 2_000, 20_000, 300_000])
def test_likeness_is_that_of_the_sets_at_every_length(n):
    """Sets of n words of which a share is common, from none to all."""
    rng = np.random.default_rng(n)
    words = [f"w{x}" for x in rng.integers(1 << 60, size=2 * n).tolist()]
    text = " ".join(words[:n])
    for common in (0, n // 2, n * 9 // 10, n):
        other = " ".join(words[n - common : 2 * n - common])
        both, union = S.jaccard(S.shingle_set(text), S.shingle_set(other))
        assert abs(fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(other)) - both / union) < (0.05 if not common else 0.16)
        if n < 3_000:
            one, two = plain_set(text), plain_set(other)
            assert (both, union) == (len(one & two), len(one | two))


def test_words_of_long_texts_are_those_of_their_slices(monkeypatch):
    text = " ".join("w" * (i % 97) + str(i) for i in range(3000)) + " " + "x" * 9000 + "\n y"
    want = S.word_hashes(text), S.shingle_set(text)
    for size in (1, 50, 5000):
        monkeypatch.setattr(S, "SLICE", size)
        assert (S.word_hashes(text) == want[0]).all() and (S.shingle_set(text) == want[1]).all()


def test_near_duplicates_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_components({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op10_near_dedup(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("rows", [5, 1024])
def test_groups_whose_members_are_not_all_alike(spark, rows, monkeypatch):
    """Chains and clouds of copies: the centre of a bucket is linked with few of them."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = {}
    for _ in range(3):
        base = words(120)
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = words(1)[0]
            texts[len(texts)] = " ".join(copy)
        for _ in range(25):
            base[rng.randrange(len(base))] = words(1)[0]
            texts[len(texts)] = " ".join(base)
        texts[len(texts)] = " ".join(base)
    ids = list(texts)
    rng.shuffle(ids)
    texts = dict(zip(ids, texts.values()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()} == plain_components(texts)


def test_only_members_with_a_likely_partner_of_another_component_get_their_texts():
    rng = np.random.default_rng(4)
    marks = rng.integers(1 << 16, size=(60, S.PERMUTATIONS)).astype("<u2")
    component = np.arange(60)
    role = np.where(np.arange(60) < 20, 1, np.where(np.arange(60) < 40, 2, 3)).astype(np.int32)
    marks[21, :100] = marks[1, :100]  # across
    marks[22, :40] = marks[2, :40]  # too few agree
    marks[23], component[23] = marks[3], 3  # one component
    marks[41, :70] = marks[59, :70]  # both held and asking
    marks[5, :100] = marks[6, :100]  # both only ask
    table = pa.table({"bucket": pa.array([7] * 60, pa.int64()), "i": pa.array([0] * 60, pa.int32()), "j": pa.array([1] * 60, pa.int32()), "node": np.arange(60), "component": component, "role": role, "marks": [m.tobytes() for m in marks]})
    got = neardup._likely(75, table)
    assert {(r["node"], r["role"]) for r in got.to_pylist()} == {(1, 1), (21, 2), (41, 3), (59, 3)} and got.num_rows == 4
    assert got.column_names == [c.split()[0] for c in neardup.LIKELY.split(", ")]
    assert neardup._likely(75, table.slice(0, 20)).num_rows == 0


@pytest.mark.parametrize("rows", [2, 1024])
def test_similarity_to_keepers_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    texts = {i: " ".join(f"w{j if j % 9 else j * i}" for j in range(3 * i, 60 + i)) for i in range(1, 16)}
    pairs = [(i, 1 if i < 12 else 12) for i in texts if i not in (1, 12)]
    got = neardup.measured(spark.createDataFrame(pairs, "node long, keeper long"), spark.createDataFrame(list(texts.items()), "node long, text string")).collect()
    sets = {i: plain_set(t) for i, t in texts.items()}
    assert sorted((r.node, r.near) for r in got) == [(a, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in sorted(pairs)]


def test_signatures_go_on_from_minima_of_a_part():
    text = " ".join(f"w{i % 70}" for i in range(200))
    whole = S.shingles(text)
    for k in (1, 50, 195):
        start = S.signature(np.unique(whole[:k]))
        assert (S.signature(np.unique(whole[k:]), start=start) == S.signature(S.shingle_set(text))).all()
    assert (S.signature(whole[:0], start=start) == start).all()
    for text in odd_texts():
        text = text or ""
        assert S.count_words(text) == len(S.word_hashes(text))
        for other in ("", "xyz", " and so on", text):
            k = fingerprints._shared(text)
            assert (S.shingles(fingerprints.edited(text, other))[:k] == S.shingles(text)[:k]).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert got == {k: v for k, v in top.items() if k != 5}


def test_odd_rows(spark, odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() > len({r.doc_id for r in rows})
    want = plain_components({r.doc_id: r.text for r in odd.where("doc_id is not null and (doc_id <> 9 or length(text) > 70)").collect()})
    assert all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in rows if r.doc_id is not None and (r.doc_id != 9 or r.n_shingles == want[9][0]))
    assert neardup.near_duplicates(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0


def test_rows_are_documents_whatever_their_ids(spark):
    text, other, third = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, text), (2, text), (2, other), (None, text), (None, third), (None, third), (3, third + " more"), (2, text), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = [(1, text, 1, 1, True), (2, text, 1, 1, False), (2, text, 1, 1, False), (2, other, 2, 2, True), (None, text, 1, 1, False), (None, third, None, 3, False), (None, third, None, 3, False), (3, third + " more", 3, 3, True), (4, "", 4, 4, True), (None, "", None, None, True)]
    texts = {r.text_key: r.text for r in neardup.keyed_texts(docs).collect()}
    got = [(r.doc_id, texts[r.text_key], r.class_id, r.component_id, r.kept) for r in neardup.groups(docs).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == docs.count() and {(r.doc_id, r.class_id, r.component_id) for r in rows} == {(x[0], *x[2:4]) for x in want}
    lost = spark.createDataFrame([(None, "a b c"), (None, "d e f"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_chars for r in fingerprints.fingerprints(lost).collect()) == [0, 5, 5]
    assert neardup.near_duplicates(lost).where("kept").count() == 3


@pytest.mark.parametrize("hot", [neardup.HOT, 0.0, 1e9])
def test_sets_meet_their_classes_with_and_without_a_shuffle(spark, sf_dir, hot, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", hot)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_components({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()} == want


def test_fingerprints(spark, sf_dir, odd):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd.where("doc_id is not null and (doc_id <> 9 or length(text) > 70)").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        order = sorted(texts, reverse=True)
        rows = fingerprints.fingerprints(docs).collect()
        assert len(rows) == len(texts)
        groups, first = plain_components(texts), {}
        for i in sorted(texts):
            first.setdefault(frozenset(plain_set(texts[i])) or i, i)
        for r in rows:
            assert (r.component_id, r.class_id) == (groups[r.doc_id][1], first[frozenset(plain_set(texts[r.doc_id])) or r.doc_id])
            own, keeper = (plain_set(texts[x]) for x in (r.doc_id, r.component_id))
            assert r.near_component == (len(own & keeper) / len(own | keeper) if own else 1)
            text, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
            n = len(text) // 3
            changed = text[: len(text) - n] + after[:n]
            one, two, three = (fingerprints.fingerprint(t) for t in (text, changed, after))
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (one.tobytes().hex(), two.tobytes().hex())
            assert (r.near_edited, r.near_next) == (float((one == two).mean()), float((one == three).mean()))
            a, b = plain_set(text), plain_set(changed)
            c = plain_set(after)
            for likeness, other in ((r.near_edited, b), (r.near_next, c)):
                assert likeness == 0 if bool(a) != bool(other) else abs(likeness - (len(a & other) / len(a | other) if a else 1)) < 0.2
    assert fingerprints.fingerprints(odd).count() == odd.count()
    assert fingerprints.fingerprints(odd.where("doc_id = 3")).first()["near_next"] == 1.0


def test_ranges_of_ids_are_even_however_many(spark):
    ids = spark.range(0, 400_000).select((F.col("id") * F.col("id") - 7_000_000_000).alias("at"))
    cuts = fingerprints.cuts_of(ids, 10_000)
    assert len(cuts) > 9_000
    sizes = [r["count"] for r in ids.groupBy(fingerprints._range_of(cuts).alias("r")).count().collect()]
    assert max(sizes) < 4 * sorted(sizes)[len(sizes) // 2] and sum(sizes) == 400_000
    some = [-9, -2, 0, 5, 5, 7, 1 << 62, -(1 << 63)]
    for few in ([], [5], [-2, 5], [-2, 0, 5, 6, 100]):
        got = {r.at: r.p for r in spark.createDataFrame([(x,) for x in some], "at long").select("at", fingerprints._range_of(few).alias("p")).collect()}
        assert got == {x: sum(c >= x for c in few) for x in some}
    assert fingerprints.cuts_of(ids.limit(0), 5) == []


def test_pipeline(spark, sf_dir, odd, empty):
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    texts = dict(zip(texts, (t for _, _, t in plain_lines(list(texts.values())))))
    texts = {i: texts[i] for i, (_, _, kept) in plain_components(texts).items() if kept}
    for i, text in texts.items():
        out, at = "", 0
        for a, _, _, b in secretscan.brute_force(text):
            out, at = (out + text[at:a] + secretscan.REDACTED, b) if a >= at else (out, max(at, b))
        texts[i] = out + text[at:]
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), collections.Counter(texts.items()), library)
    for df in (odd, empty):
        now = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert langid.UNKNOWN not in {r.lang_pred for r in langid.predict(corpus_pipeline.language_id(spark, odd, sf_dir), langid.learn(odd)).collect()}


def test_near_duplicates_go_by_row(spark, sf_dir):
    text, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, text, 7), (2, text, 8), (2, other, 9), (2, other, 9), (3, None, 1), (3, None, 1), (None, text, 5), (None, "c d e f g h", 6), (None, "c d e f g h", 6), (4, "C d e F g h", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long").selectExpr("*", "'x' as text_key", "'y' as at_id", "map('k', n_lines) as more")
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.text_key, r.at_id, r.more["k"]) for r in kept.collect()) == collections.Counter((i, t, n, "x", "y", n) for i, t, n in [rows[0], rows[2], rows[4], rows[4], rows[9]])
    apart = corpus_pipeline.near_dedup(spark, docs.where("doc_id <> 2"), sf_dir)
    assert sorted(r.doc_id for r in apart.collect()) == [1, 3, 3, 4]


def test_the_same_one_of_repeated_rows_stays(spark, sf_dir):
    """Rows with one id and text that differ in another column only."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", f"src{i}", i) for i in range(9, 0, -1)] + [(2, text, "en", "src0", 0), (3, "other words " * 5, "en", "b", 1), (3, "other words " * 5, "en", "a", 2)]
    for n in (1, 4):
        for way in (1, -1):
            docs = spark.createDataFrame(rows[::way], "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
            assert sorted((r.doc_id, r.source, r.n_chars) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == [(1, "src1", 1), (3, "a", 2)]


def test_stages_keep_rows_and_columns(spark, sf_dir, odd):
    others = lambda df: collections.Counter(tuple(r) for r in df.drop("text", "n_chars").collect())
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.secret_scan):
        assert others(stage(spark, odd, sf_dir)) == others(odd)
    kept = corpus_pipeline.near_dedup(spark, odd, sf_dir)
    assert not others(kept) - others(odd) and kept.columns == odd.columns
    words = [r for r in kept.collect() if plain_set(r.text)]
    assert len(words) == len({frozenset(plain_set(r.text)) for r in words}) and {frozenset(plain_set(r.text)) for r in words} <= {frozenset(plain_set(r.text)) for r in odd.collect()}


def test_pipeline_keeps_documents_without_usable_labels(spark, odd, sf_dir):
    want = collections.Counter(r.doc_id for r in odd.collect() if any(c.isalpha() for c in r.text or ""))
    for label in (None, langid.UNKNOWN):
        docs = odd.withColumn("lang", F.lit(label).cast("string"))
        kept = corpus_pipeline.language_id(spark, docs, sf_dir)
        assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == want


def test_bands_and_sift_follow_percent():
    assert (neardup.band_rows(75), neardup.sift(75)) == (4, 0.5)
    assert neardup.band_rows(50) < 4 < neardup.band_rows(90) and neardup.sift(50) < 0.3
    with pytest.raises(ValueError):
        neardup.band_rows(0)


def test_links_at_a_lower_threshold(spark):
    """Pairs that share 137 of 263 shingles, 52 percent."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, want = {}, {}
    for i in range(0, 400, 2):
        both = words(141)
        for k in (i, i + 1):
            texts[k], want[k] = " ".join(both + words(63)), (200, i, k == i)
        one, two = plain_set(texts[i]), plain_set(texts[i + 1])
        assert (len(one & two), len(one | two)) == (137, 263)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 50).collect()} == want
