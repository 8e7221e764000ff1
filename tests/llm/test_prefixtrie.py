"""The trie of conversation prefixes against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    sequence = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        sequence[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in sequence.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for node, convs in members.items():
        under = [s for s in members if s[: len(node)] == node]
        inner = {s[:-1] for s in under if s}
        saved = sum((len(members[s]) - 1) * len(s[-1][1].split()) for s in under if s)
        ends = ",".join(str(c) for c in sorted(convs) if sequence[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(s) == len(node) + 1 for s in under), sum(s not in inner for s in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in prefixtrie.trie(df).collect())


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 90), *range(-25, 0), 2**55 + 1, 2**55 + 3, 2**60, None]:
        for turn in range(rng.randrange(1, 6)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", " a  b ", "c", "", None, "d e f"])))
    rows += rows[:30]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("keys", F.lit("clash")).withColumn("node", F.lit(1)).repartition(5)
    assert found(df) == expected(rows)


def test_hot_conversation_and_first_turn(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 7)
    monkeypatch.setattr("codeloom.llm.common.HOT_KEYS", 8)
    rows = [(c, t, "user", "same words here") for c in range(400) for t in range(3) if c % 3 == 0] + [(c, t, "user", f"text {c * t}") for c in range(400) for t in range(4) if c % 3]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_long_conversation_and_text(spark):
    rows = [(20, t, "user", f"turn {t}") for t in range(3000)] + [(21, 0, "user", "word " * 200_000)]
    out = prefixtrie.trie(spark.createDataFrame(rows, SCHEMA))
    assert out.agg(F.max("depth")).first()[0] == 3000
    assert out.where("depth = 0").select("n_convs", "n_leaves").first() == (2, 2)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")]])
def test_no_conversation(spark, rows):
    assert found(spark.createDataFrame(rows, SCHEMA)) == []


def test_without_turns(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert found(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA)) == expected([(c, 0, "user", "x")])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(same_as_sql, sf):
    same_as_sql("op11_prefix_trie", f"/root/testdata/{sf}")
