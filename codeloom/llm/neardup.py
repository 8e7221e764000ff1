"""Near-duplicate groups: MinHash bands, checked links, connected components.

Rows with equal shingle sets are one class, so a text with thousands of copies is compared once. A class is
known by a number, the row of its first member.
The bands of each class's signature deal it to buckets. First the members of a bucket are compared
with one centre, the smallest: signatures sift these pairs, full shingle sets confirm them, and
large-star and small-star steps join what is linked. A bucket whose members are then one component
needs nothing more. In the others, the members outside the bucket's main component are held against all its
members, block by block. A block's signatures come first, and texts only for the members that they leave: an index
of the shingles in a block counts all intersections of a document at once, and only links that join components come
out. So no link that could join two components stays unchecked, no pairs are made, and a task holds two blocks of
bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import shingles as S
from codeloom.llm.common import drop_table, materialize, met, release, shuffle_partitions, texts, unused

#: Most chance that a pair at the threshold shares no band; 32 bands of 4 minima miss 5 in a million at a similarity of 0.75.
MISSED = 1e-5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Pairs whose signatures agree in a share so many standard deviations below the threshold can't be links.
DEVIATIONS = 6.5
#: Most documents, and about the most bytes of text, in a block of a bucket's members.
BLOCK_ROWS, BLOCK_BYTES = 1024, 32 << 20
#: A set is hot if it has more than this share of a shuffle partition's rows, so at most 1 / HOT sets for each partition are.
HOT = 0.25
#: Bits of the mask that holds rows back from a shuffle: 4 MB at most. With more keys than that it holds fewer rows back.
MASK_BITS = 1 << 24

LIKELY = "bucket long, i int, j int, node long, component long, role int"
SKETCH = "row long, doc_id long, text_key long, n_shingles long, set_a long, set_b long, marks binary"


def band_rows(percent: int) -> int:
    """The most minima in a band that keep to MISSED for pairs at percent (4 for 75)."""
    p = percent / 100
    fit = [r for r in range(1, S.PERMUTATIONS + 1) if (1 - p**r) ** (S.PERMUTATIONS // r) <= MISSED] if 0 < p <= 1 else []
    if not fit:
        raise ValueError(f"{S.PERMUTATIONS} minima can't find links at {percent} percent")
    return max(fit)


def sift(percent: int) -> float:
    """The least share of agreeing minima of a likely link (0.5 for 75)."""
    p, n = percent / 100, S.PERMUTATIONS
    return max(0, math.floor(n * p - DEVIATIONS * math.sqrt(n * p * (1 - p)))) / n


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, a hash of the text: rows that agree in doc_id and text_key are repeated rows."""
    return texts(docs).withColumn("text_key", F.xxhash64("text"))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, a, b, marks = [], [], [], []
        for text in batch.column("text"):
            own = S.shingle_set(text.as_py())
            n.append(len(own))
            one, two = S.digest(own)
            a.append(one)
            b.append(two)
            marks.append(S.marks(S.signature(own)).tobytes() if len(own) else b"")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "text_key")), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(marks, pa.binary())], names=[x.split()[0] for x in SKETCH.split(", ")])


def sketches(docs: DataFrame) -> DataFrame:
    """A number for each row, size and digest of its shingle set, and the marks of its signature (none if empty)."""
    rows = keyed_texts(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "doc_id", "text_key", "text").mapInArrow(_sketched, SKETCH)


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _dealt(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            found = S.bands(_marks(part.column("marks")), rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), found.shape[1])), pa.array(found.ravel())], names=["node", "bucket"])


def _sifted(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            batch = batch.filter(pa.array((_marks(batch.column("marks_a")) == _marks(batch.column("marks_b"))).mean(axis=1) >= least))
        yield batch.select(["a", "b"])


def _linked(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, np.ndarray] = {}
        keep = []
        for one, two in zip(batch.column("text_a"), batch.column("text_b")):
            sets = []
            for text in (one.as_py(), two.as_py()):
                if text not in known:
                    if len(known) > 200:
                        known.clear()
                    known[text] = S.shingle_set(text)
                sets.append(known[text])
            both, union = S.jaccard(*sets)
            keep.append(bool(both) and 100 * both >= percent * union)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def confirmed(pairs: DataFrame, marks: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs a, b that are links: sifted on signatures, confirmed on full sets."""
    side = lambda of, x: of.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in of.columns if c != "node"])
    least = sift(percent)
    likely = pairs.join(side(marks, "a"), "a").join(side(marks, "b"), "b").select("a", "b", "marks_a", "marks_b").mapInArrow(lambda it: _sifted(least, it), "a long, b long")
    likely = likely.join(side(bodies, "a"), "a").join(side(bodies, "b"), "b").select("a", "b", "text_a", "text_b")
    return likely.mapInArrow(lambda it: _linked(percent, it), "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the graph with edges a, b, by alternating stars.

    Large-star links each node's larger neighbours to the smallest node around it, small-star its
    smaller ones and itself. Both only need the smallest neighbour of a node, an aggregate that
    combines before the shuffle, so a node with very many neighbours is no burden. Nodes without an
    edge don't appear. Each round is written, and one number tells whether it changed anything.
    """
    ways = lambda e: e.union(e.select("b", "a").toDF(*e.columns))
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tell = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    before = tell(now)
    while before[0]:
        both = ways(now)
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        old, now = now, materialize(small.where("a <> b").distinct(), "edges")
        after = tell(now)
        drop_table(old)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def masked(rows: DataFrame, wanted: DataFrame, keys: list[str], wanted_keys: list[str]) -> DataFrame:
    """Those rows whose keys may be among the wanted ones: all that are, and of others the few that meet a set bit.

    The mask has at most MASK_BITS / 64 rows whatever the number of keys, so it can go to all executors, and most of the
    rows that a join would only drop aren't shuffled for it.
    """
    bit = lambda names: F.pmod(F.xxhash64(*names), F.lit(MASK_BITS))
    mask = wanted.select(bit(wanted_keys).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    word, bits, place = unused(rows, "word", "bits", "place")
    found = rows.withColumn(place, bit(keys)).join(F.broadcast(mask.select(F.col("word").alias(word), F.col("bits").alias(bits))), F.shiftright(place, 6) == F.col(word))
    return found.where(F.getbit(bits, F.col(place).bitwiseAND(63).cast("int")) == 1).select(*rows.columns)


def linked_classes(sketch: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT, measure: bool = False) -> DataFrame:
    """node and top, the class that stands for its component, of the classes that have links with other classes; near,
    the exact Jaccard similarity to that class, null if not to be measured. sketch and classes: written tables."""
    rows = band_rows(percent)
    own = sketch.select(F.col("row").alias("node"), "marks").join(classes.select("node"), "node", "left_semi")
    dealt = own.mapInArrow(lambda it: _dealt(rows, it), "node long, bucket long")
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last").drop("last")
    buckets = materialize(dealt.join(shared, "bucket").select("node", "centre", "bucket"), "buckets")
    members = buckets.select("node").distinct()
    marks = materialize(sketch.select(F.col("row").alias("node"), "marks").join(members, "node", "left_semi"), "marks")
    # the text of a class is that of the row that stands for it; rows repeated word for word give it once
    where = materialize(classes.join(members, "node", "left_semi").select("node", F.col("doc_id").alias("at_id"), F.col("text_key").alias("at_key")), "places")
    found = masked(keyed_texts(docs), where, ["doc_id", "text_key"], ["at_id", "at_key"]).join(where, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")))
    bodies = materialize(found.groupBy("node").agg(F.first("text").alias("text")), "bodies")
    drop_table(where)
    star = buckets.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = materialize(confirmed(star, marks, bodies, percent), "links")
    joined = connected_components(links)
    components = materialize(joined, "components")
    members = buckets.select("bucket", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    across = materialize(links_across(members, marks, bodies, percent), "links")
    found = connected_components(links.union(across))
    own = classes.select("node", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "node").alias("own"))
    named = found.join(own, "node")
    out = named.join(named.groupBy("component").agg(F.min("own").alias("top")), "component").select("node", "top")
    if measure:
        near = materialize(measured(out.select("node", F.col("top.node").alias("keeper")).where("node <> keeper"), bodies), "near")
        out = out.join(near, "node", "left").select("node", "top", F.coalesce("near", F.lit(1.0)).alias("near"))
    else:
        out = out.withColumn("near", F.lit(None).cast("double"))
    for table in (buckets, marks, bodies, links, joined, components, across):  # out reads none of them
        drop_table(table)
    release(docs.sparkSession)
    return out


def measured(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """node, near: the exact Jaccard similarity of classes to their keepers, from pairs node, keeper.

    The text of a keeper goes once to each part of its nodes, BLOCK_ROWS of them, so one with very many is no burden.
    """
    sizes = pairs.groupBy("keeper").agg(F.count("*").alias("n"))
    total = pairs.count()
    dealt = met(pairs, sizes.withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS)), ["keeper"], "n", total)
    dealt = dealt.select("keeper", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node").join(bodies, "node")
    parts = sizes.select("keeper", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK_ROWS) - 1)).alias("part"))
    keepers = parts.join(bodies.withColumnRenamed("node", "keeper"), "keeper").select("keeper", "part", F.col("text").alias("other"))
    return dealt.join(keepers, ["keeper", "part"]).select("node", "text", "other").mapInArrow(_measured, "node long, near double")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, kept = None, None
    for batch in batches:
        near = []
        for text, other in zip(batch.column("text"), batch.column("other")):
            other = other.as_py()
            if kept is None or other != last:
                last, kept = other, S.shingle_set(other)
            both, union = S.jaccard(S.shingle_set(text.as_py()), kept)
            near.append(both / union)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(near, pa.float64())], names=["node", "near"])


def links_across(members: DataFrame, marks: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links that join components of members (bucket, node, component) which share a bucket.

    Buckets of two are left out: their only pair has been compared. Each row goes to the blocks that it is held against
    or in; how many blocks a bucket has follows from its members' number and length. First only the signatures go there,
    then the texts of those rows that have a likely partner in a block.
    """
    members = members.join(bodies.select("node", F.octet_length("text").alias("bytes")), "node")
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    several = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("components")).where("components > 1 and n > 2")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")
    several = several.select("bucket", F.col("top.component").alias("main"), blocks(F.col("n"), F.col("bytes")).alias("wide"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("tall"))
    rows = members.join(several, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), "tall").cast("int")).withColumn("j", F.pmod(F.xxhash64("node"), "wide").cast("int"))
    # role 1: held against the block's members; 2: one of these; 3: both
    dealt = F.expr("""if(tall = 1 and wide = 1, array(named_struct('i', 0, 'j', 0, 'role', if(outside, 3, 2))),
        concat(transform(sequence(0, tall - 1), x -> named_struct('i', x, 'j', j, 'role', 2)),
               if(outside, transform(sequence(0, wide - 1), x -> named_struct('i', i, 'j', x, 'role', 1)), array())))""")
    rows = rows.select("bucket", "node", "component", F.explode(dealt).alias("at")).select("bucket", "at.*", "node", "component")
    likely = rows.join(marks, "node").groupBy("bucket", "i", "j").applyInArrow(lambda table: _likely(percent, table), LIKELY)
    return likely.join(bodies, "node").groupBy("bucket", "i", "j").applyInArrow(lambda table: _across(percent, table), "a long, b long")


def _likely(percent: int, table: pa.Table) -> pa.Table:
    """Those rows of a block that can have a link with another component by their signatures, in the roles left to them."""
    of, role, marks = table.column("component").to_numpy(), table.column("role").to_numpy(), _marks(table.column("marks"))
    inside, least = np.flatnonzero(role & 2), sift(percent) * S.PERMUTATIONS
    own, left = marks[inside], np.zeros(len(role), role.dtype)
    for i in np.flatnonzero(role & 1):
        found = inside[(np.count_nonzero(own == marks[i], axis=1) >= least) & (of[inside] != of[i])]
        if len(found):
            left[i] |= 1
            left[found] |= 2
    keep = np.flatnonzero(left)
    out = table.select(["bucket", "i", "j", "node", "component"]).take(pa.array(keep))
    return out.append_column("role", pa.array(left[keep], pa.int32()))


def _across(percent: int, table: pa.Table) -> pa.Table:
    ids, of, role = (table.column(c).to_numpy() for c in ("node", "component", "role"))
    sets = [S.shingle_set(text.as_py()) for text in table.column("text")]
    inside = np.flatnonzero(role & 2)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(inside)), size[inside])
    every = np.concatenate([sets[i] for i in inside]) if len(inside) else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(role & 1).tolist():
        first, last = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        n = last - first
        places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[places], minlength=len(inside))
        linked = (both > 0) & (100 * both >= percent * (size[i] + size[inside] - both)) & (of[inside] != of[i])
        for k in inside[linked].tolist():
            x, y = root(int(of[i])), root(int(of[k]))
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((int(ids[i]), int(ids[k])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def groups(docs: DataFrame, percent: int = PERCENT, measure: bool = False) -> DataFrame:
    """The groups that near duplicates form: doc_id, text_key, n_shingles, class_id, component_id, kept, near, one row for each input row.

    class_id is the smallest doc_id with an equal shingle set, component_id the smallest reachable over links. Each
    row is a document, also if others have its doc_id; a null doc_id counts as the largest, so an id is null only if no
    row that it stands for has one. Of a group the row with that smallest id is kept (of several, the one with the
    smallest text_key), with what repeats it word for word. Rows without shingles (null, empty or
    white text) are linked with nothing and kept. near is the exact Jaccard similarity to the row that stands for the
    component (1 for a row without links), null if not to be measured. An empty table has no rows.
    """
    return _grouped(docs, percent, measure)[0]


def written_groups(docs: DataFrame, percent: int = PERCENT, where: str = "true", measure: bool = False) -> DataFrame:
    """The rows of groups() that meet a condition, written once; the tables that they come from are deleted."""
    rows, tables = _grouped(docs, percent, measure)
    out = materialize(rows.where(where), "groups")
    for table in tables:
        drop_table(table)
    release(docs.sparkSession)
    return out


def _grouped(docs: DataFrame, percent: int, measure: bool) -> tuple[DataFrame, list[DataFrame]]:
    sketch = materialize(sketches(docs), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "row"))
    classes = sketch.where("n_shingles > 0").groupBy("set_a", "set_b").agg(first.alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.select("set_a", "set_b", F.col("first.row").alias("node"), "first.doc_id", "first.text_key", "n"), "classes")
    linked = linked_classes(sketch, classes, docs, percent, measure)
    near = F.when(F.col("top").isNull(), F.lit(1.0) if measure else F.lit(None)).otherwise(F.col("near")).alias("near")
    own = classes.join(linked, "node", "left").select("set_a", "set_b", "n", near, F.col("doc_id").alias("class_id"), F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"), F.when(F.col("top").isNull(), F.col("text_key")).otherwise(F.col("top.text_key")).alias("keeper"))
    own = materialize(own, "classes")
    drop_table(classes)
    rows = sketch.select("doc_id", "text_key", "n_shingles", "set_a", "set_b")
    # rows of hot sets, few sets by this bound, meet them without a shuffle; no other set has many rows for one task
    bound = (own.agg(F.sum("n")).first()[0] or 0) * HOT / shuffle_partitions(docs.sparkSession)
    hot, rest = F.broadcast(own.where(F.col("n") > bound)), own.where(F.col("n") <= bound)
    some = rows.where("n_shingles > 0")
    told = some.join(hot, ["set_a", "set_b"]).unionByName(some.join(hot.select("set_a", "set_b"), ["set_a", "set_b"], "left_anti").join(rest, ["set_a", "set_b"]))
    told = told.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("keeper")))
    alone = rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0 if measure else None).cast("double").alias("near"))
    return told.select(*alone.columns).unionByName(alone), [sketch, own]


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; see groups()."""
    return groups(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")
