"""The trie of conversation prefixes, from whole sequences.

Conversations that are rebuilt alike collapse into one sequence with a weight. A sequence is known by the digests
of its prefixes, a chain in which each turn is hashed with what lies before it, so a node of the trie is a digest and
texts move once, to their conversation. Sequences that are proper prefixes of others are dropped by an anti-join; those
left are the leaves. Nodes are aggregates over the prefixes of weighted sequences, so a prefix that very many share is
added up in the tasks that read it.

What a node saves is summed over its subtree without a walk: each node belongs to the first of its leaves, so along
a leaf's path its own nodes are a tail, and a subtree's sum is the sum of the tails of its leaves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, met, shuffle_partitions

#: Conversation c begins with turns of c - c % SPREAD: as many as the CRC-32 of its decimal number leaves when divided by HEADS.
SPREAD, HEADS = 20, 4
#: Bytes of a digest; ids in one chunk of a list of ends.
DIGEST, CHUNK = 16, 4096

REBUILT = "conv_id long, keys array<binary>, tails array<long>"


def _chained(turns: list[tuple[str, str]]) -> tuple[list[bytes], list[int]]:
    """The digest of each prefix, from the empty one on; the words of the texts from each depth on (all at the root)."""
    keys, words = [hashlib.blake2b(b"", digest_size=DIGEST).digest()], []
    for role, text in turns:
        who, said = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        keys.append(hashlib.blake2b(keys[-1] + len(who).to_bytes(8, "little") + who + said, digest_size=DIGEST).digest())
        words.append(len(said.split()))
    tails = [0] * (len(turns) + 1)
    for i in range(len(turns), 0, -1):
        tails[i - 1] = tails[i] + words[i - 1]
    return keys, [tails[0], *tails[:-1]]


def _rebuilt(group: pa.Table) -> pa.Table:
    group = group.append_column("numbered", pc.is_valid(group.column("turn"))).sort_by([(c, "ascending") for c in ("conv_id", "numbered", "turn", "role", "text")])
    own: dict[int, list[tuple[str, str]]] = {}
    for c, role, text in zip(*(group.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
        own.setdefault(c, []).append((role, text))
    keys, tails = [], []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % HEADS
        found = _chained(own.get(group.column("base")[0].as_py(), [])[:h] + turns[h:])
        keys.append(found[0])
        tails.append(found[1])
    return pa.table({"conv_id": pa.array(own, pa.int64()), "keys": pa.array(keys, pa.list_(pa.binary())), "tails": pa.array(tails, pa.list_(pa.int64()))})


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (digests of the prefixes, the empty one first), tails (words from each depth on) of every conversation.

    At most SPREAD conversations meet in a group.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.withColumn("base", F.expr(f"conv_id - conv_id % {SPREAD}")).groupBy("base").applyInArrow(_rebuilt, REBUILT)


def _chunks(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a key's ids as text: key, first, ids."""
    key, ids = None, []
    row = lambda: pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})
    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (k != key or len(ids) == most):
                yield row()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield row()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each key, which follow each other."""
    key, state = None, None
    row = lambda: pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [state.hexdigest()]})
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if state:
                    yield row()
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
    if state:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of each key's ids, ascending, joined by commas. ends: key, conv_id.

    Ranges of (key, id) deal a key with very many ids to many tasks, which join runs of ids to texts; the one task that a
    digest takes then reads these texts one after the other, and holds none but the last.
    """
    n, most = shuffle_partitions(ends.sparkSession), CHUNK
    runs = ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lambda it: _chunks(most, it), "key binary, first long, ids string")
    return runs.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(_digested, "key binary, ends_sha256 string")


def sequences(all_rebuilt: DataFrame) -> DataFrame:
    """key, weight, conv_id (the smallest), keys, tails of each distinct sequence."""
    rows = all_rebuilt.select(F.element_at("keys", -1).alias("key"), "conv_id", "keys", "tails")
    return rows.groupBy("key").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.first("keys").alias("keys"), F.first("tails").alias("tails"))


def leaves(weighted: DataFrame) -> DataFrame:
    """The sequences that are no proper prefix of another."""
    inner = weighted.select(F.explode(F.expr("slice(keys, 1, size(keys) - 1)")).alias("key")).distinct()
    return weighted.join(inner, "key", "left_anti")


def _prefixes(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each prefix: node, at (depth), up (the node above) and the named columns."""
    return rows.select(F.posexplode("keys").alias("at", "node"), "keys", "tails", *keep).select("node", "at", F.expr("if(at > 0, keys[at - 1], null)").alias("up"), F.expr("tails[at]").alias("tail"), "tails", *keep)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    A conversation is its turns in the order of turn (null first; turns with one number by role and text), rebuilt as
    rebuilt() says; null role and text are empty, repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation and make no node. A table without conversations has no node; any other has a root, also if its
    conversations are rebuilt without turns. One conversation's turns must fit into a task, as a text must.
    """
    every = materialize(rebuilt(conversations), "rebuilt")
    weighted = materialize(sequences(every), "sequences")
    tips = materialize(leaves(weighted), "leaves")

    nodes = _prefixes(weighted, "weight", "conv_id").groupBy("node").agg(F.min("at").alias("depth"), F.min("up").alias("up"), F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("weight") * F.col("tail")).alias("said"))
    owned = materialize(_prefixes(tips, "key").groupBy("node").agg(F.min("at").alias("at"), F.count("*").alias("n_leaves"), F.min("key").alias("owner")), "owned")
    own = owned.groupBy(F.col("owner").alias("key")).agg(F.min("at").alias("own_from"))
    once = _prefixes(tips.join(own, "key"), "own_from").groupBy("node").agg(F.sum(F.expr("tails[greatest(at, own_from)]")).alias("told"))
    nodes = materialize(nodes.join(owned.select("node", "n_leaves"), "node").join(once, "node"), "nodes")

    children = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    ends = end_digests(every.select(F.element_at("keys", -1).alias("key"), "conv_id")).withColumnRenamed("key", "node")
    parents = nodes.join(children, "node").select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("below"))
    out = nodes.join(children, "node", "left").join(ends, "node", "left")
    out = met(out, materialize(parents, "parents"), ["up"], "below", nodes.count())
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("said") - F.col("told")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
