"""Document fingerprints: MinHash signatures of word shingles, and links found with them.

A fingerprint is 128 minima of universal hash functions over the document's shingle set, 16 bits of
each, in hexadecimal. Its likeness to another is the share of minima that agree, which estimates the
Jaccard similarity of the sets. similar() finds the links between documents: bands of the signatures are joined in
Spark, and Jaccard is verified on the full sets of what they bring together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import neardup
from codeloom.llm import shingles as S
from codeloom.llm.common import shuffle_partitions

#: Values of the sample for each bound of a range of ids.
PER_CUT = 20
#: Ranges for each shuffle partition.
RANGES = 3

KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "class_id": pa.int64(), "component_id": pa.int64(), "near_component": pa.float64()}
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, component_id long, near_component double"


def fingerprint(text: str) -> np.ndarray:
    """The marks of the text's signature. A text without words has only zeros."""
    return S.marks(S.signature(S.shingle_set(text)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, other: str) -> str:
    """The last third of the text's code points replaced by the first as many (or all) of other."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def _shared(text: str) -> int:
    """How many of the text's shingles come first in its edited text too: those of words that end within what stays."""
    return max(0, S.count_words(text[: len(text) - len(text) // 3]) - S.WIDTH)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of part, then falling id; what is known of an id's groups comes before its texts, and each part
    ends with a guest, the first of the next."""
    held: tuple | None = None
    groups: dict[int, tuple[int, int, float]] = {}
    near = None
    for batch in batches:
        out: list[list] = [[] for _ in KINDS]
        columns = [batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "guest", "text_key", "class_id", "component_id", "near_component")]
        for part, at, doc_id, guest, key, *group, text in zip(*columns, batch.column("text")):
            if near != at:
                near, groups = at, {}
            if not text.is_valid:
                groups[key] = tuple(group)
                continue
            text = text.as_py()
            own = S.shingles(text)
            shared = 0 if guest else _shared(text)
            start = S.signature(np.unique(own[:shared])) if shared else None
            own = S.marks(S.signature(np.unique(own[shared:]), start=start))
            if held and held[0] == part:
                _, held_id, before, print_, group, first, minima = held
                changed = edited(before, text)
                new = S.marks(S.signature(np.unique(S.shingles(changed)[first:]), start=minima)) if changed != before else print_
                row = (held_id, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), print_.tobytes().hex(), new.tobytes().hex(), likeness(print_, new), likeness(print_, own), *group)
                for column, value in zip(out, row):
                    column.append(value)
            held = None if guest else (part, doc_id, text, own, groups.get(key, (doc_id, doc_id, 1.0)), shared, start)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, KINDS.values())], names=list(KINDS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses; its class and component of similar(),
    and near_component, its set's verified Jaccard similarity to that of the row which stands for the component.

    The next document is the one with the next smaller doc_id (after the smallest: the largest; a null is smaller than all;
    among rows with one doc_id: by length, then text); a lone document is its own next. Null is an
    empty text, which is like any other text without words and like nothing else. One row for each input row.

    Documents are dealt into ranges of ids, some ranges for each shuffle partition, and sorted; the
    first of each range also goes to the end of the range before, as a guest. Texts move once; the few
    numbers of a document's groups go the same way and meet it there. All rows of one doc_id are in one range, and so are those without one.
    """
    spark, at = docs.sparkSession, F.coalesce(F.col("doc_id").cast("long"), F.expr(f"-{(1 << 63) - 1}L - 1L")).alias("at")
    groups = similar(docs, where="n_shingles > 0 and not (class_id <=> doc_id and component_id <=> doc_id and near = 1)").withColumnRenamed("near", "near_component")
    all_ = neardup.keyed_texts(docs).withColumn("at", at)
    n = shuffle_partitions(spark)
    part = _range_of(cuts_of(docs.where("doc_id is not null").select(at), RANGES * n))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("class_id", "long"), ("component_id", "long"), ("near_component", "double"))]
    dealt = all_.select("at", "doc_id", "text_key", "text", part.alias("part"), F.lit(False).alias("guest"), *none)
    told = groups.withColumn("at", at).select("at", "doc_id", "text_key", F.lit(None).cast("string").alias("text"), part.alias("part"), F.lit(False).alias("guest"), "class_id", "component_id", "near_component").distinct()
    heads = docs.select(at).withColumn("part", part).groupBy("part").agg(F.max("at").alias("at"))
    heads = {r["part"]: r["at"] for r in heads.collect()}  # one id for each part
    if not heads:
        return spark.createDataFrame([], OUT)
    filled = sorted(heads)
    ahead = [(filled[i - 1], heads[p]) for i, p in enumerate(filled)]
    first = spark.createDataFrame(ahead, "to_part int, at long")
    guests = all_.join(F.broadcast(first), "at")
    guests = guests.groupBy("to_part", "at").agg(F.max(F.struct(F.length("text"), "text")).alias("top"))
    guests = guests.select("at", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.col("top.text").alias("text"), F.col("to_part").alias("part"), F.lit(True).alias("guest"), *none)
    rows = dealt.unionByName(told).unionByName(guests)
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "guest", F.desc("at"), F.col("text").isNotNull(), F.length("text").desc(), F.desc("text"))
    return rows.mapInArrow(_rows, OUT)


def cuts_of(at: DataFrame, parts: int) -> list[int]:
    """Bounds that cut the column at into about so many ranges of equal size, from a sample by hash of at most about PER_CUT values for
    each bound; the error falls as the number of ranges grows."""
    n = at.count()
    one_in = max(1, n // (PER_CUT * parts))
    sample = at.where(F.pmod(F.xxhash64("at"), F.lit(one_in)) == 0).distinct().collect()
    values = sorted(r["at"] for r in sample)
    return sorted({values[len(values) * i // parts] for i in range(1, parts)}) if values else []


def _range_of(cuts: list[int]) -> Column:
    """Number of an id's range, from the highest ids on: how many of the sorted cuts are not below it, found by halving."""
    if not cuts:
        return F.lit(0)
    table, steps = f"cast(split('{','.join(map(str, cuts))}', ',') as array<bigint>)", [1 << i for i in reversed(range(len(cuts).bit_length()))]
    below = f"aggregate(array({', '.join(map(str, steps))}), 0, (k, s) -> if(k + s <= {len(cuts)}, if(element_at({table}, least(k + s, {len(cuts)})) < at, k + s, k), k))"
    return F.expr(f"{len(cuts)} - {below}")


def similar(docs: DataFrame, percent: int = neardup.PERCENT, where: str = "true") -> DataFrame:
    """doc_id, text_key, n_shingles, class_id of each row (the smallest doc_id with an equal shingle set), component_id
    (the smallest reachable over verified links) and near (the Jaccard similarity to the row that stands for the
    component): bands of the signatures joined in Spark, Jaccard verified on full sets.
    Only rows that meet the condition come out, as a written table."""
    return neardup.written_groups(docs, percent, where, measure=True).drop("kept")
