"""Ranked lexical search against plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import lexical

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def expected(docs, items, k=10):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, own in held:
            m = 100 - 75 + (75 * len(own) * n_docs) // n_terms
            score = 0
            for t in words(text):
                if tf := own.count(t):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def found(spark, docs, items, parts=3):
    own = spark.createDataFrame(docs, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).repartition(parts)
    return sorted(repr(tuple(r)) for r in lexical.ranked(own, spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(0))).collect())


def random_rows(seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["a", "B", "c3", "é", "É", "日本", "x-y", "_", "zz", "\x7f", "q\x00r"]) for _ in range(rng.randrange(n)))
    docs = [(i, some(30)) for i in range(120)] + [(7, "a b"), (7, "a b"), (None, "a b c3"), (None, None), (500, None), (501, ""), (502, " - ")]
    return docs, [(i, some(12)) for i in range(12)] + [(3, "a a a zz"), (90, None), (91, ""), (None, "b"), (92, "unknown words")]


def test_random_rows(spark):
    docs, items = random_rows(1)
    assert found(spark, docs, items) == expected(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 4)
    docs, items = random_rows(2)
    assert found(spark, docs, items) == expected(docs, items)


def test_ties_in_many_tiles(spark):
    docs = [(i, "same text here") for i in range(3000, 0, -1)] + [(i, f"other words {i}") for i in range(4000, 5000)]
    assert found(spark, docs, [(1, "same"), (2, "words same")], 7) == expected(docs, [(1, "same"), (2, "words same")])


def test_empty(spark, empty):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a")], [])


def test_tiles_stay_below_two_to_53(monkeypatch):
    """Weights that no tile can hold are dealt to several columns, and sums stay exact."""
    rows = [{"item_id": 1, "text": "a b " + "c " * 5}, {"item_id": 2, "text": "c b"}]
    block = lexical.asked(rows)
    block = block._replace(times=block.times * 40_000_000)
    own = lexical.weights(block, 1000, {t: 1 for t in block.vocabulary.values()})
    for columns, item, column, weight in own.tiles:
        table = np.zeros((2, len(columns)), object)
        table[item, column] = weight
        assert max(table.sum(axis=1)) * lexical.IMPACT < 2**53
    assert len(own.tiles) > 3
    row, term, impact = np.array([0, 0, 1, 2]), np.array([0, 2, 2, 1]), np.array([999_999, 77_777, 999_999, 123_457])
    got = lexical.scores(own, len(block.vocabulary), row, term, impact, 3)
    w = math.floor(1000 * math.log(2002 / 3))
    want = np.zeros((2, 3), object)
    for i, t, times in zip(block.item.tolist(), block.term.tolist(), block.times.tolist()):
        for r, u, x in zip(row.tolist(), term.tolist(), impact.tolist()):
            want[i, r] += times * w * x if t == u else 0
    assert got.tolist() == want.tolist()


def test_long_text_in_slices(monkeypatch):
    text = "Alpha béta;gamma " * 3000
    whole = lexical.counted(text)
    monkeypatch.setattr(lexical, "SLICE", 100)
    assert lexical.counted(text) == whole == {b"alpha": 3000, "béta".encode(): 3000, b"gamma": 3000}
    assert lexical.counted("x" * 5000) == {b"x" * 5000: 1}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(same_as_sql, sf):
    same_as_sql("op12_lexical_search", f"/root/testdata/{sf}")
