"""Exact duplicates: rows grouped by a 128-bit hash of their normalised text, bytes compared inside the groups.

First only hashes move: a group is a count and its smallest row. Texts move only for groups of several rows, and of
each such group a task sends two of them, its smallest and its largest text in byte order. If these are equal
for the whole group, all its texts are; else the hash has collided, and its rows are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import drop_table, materialize, met, unused
from codeloom.llm.neardup import masked

#: Runs of white space that aren't a single space already: what is replaced is little, the result the same.
WHITE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_RUN, " ")


def content_hash(body: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(body))


def _hashed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, body, h, and order: what decides between rows that share the smallest doc_id, a hash of all columns."""
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("order"))
    return rows.withColumn("h", digest(F.col("body")))


def _grouped(rows: DataFrame) -> DataFrame:
    """h, own, n, first of the groups of several rows."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "order", "row"))
    found = rows.groupBy("h", "own").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    return found.select("h", "own", F.col("n").alias("group_size"), F.col("first.doc_id").alias("keep_id"), F.col("first.order").alias("keep_order"), F.col("first.row").alias("keep_row"))


def collisions(hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """h of those groups whose texts differ. hashed: rows with h and body."""
    ends = masked(hashed.select("h", "body"), groups, ["h"], ["h"]).groupBy("h").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return ends.where("low <> high").select("h")


def _classes(docs: DataFrame, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows by number, their groups of several, and the hashes that collided (none: None), each written."""
    hashed = _hashed(docs, digest)
    number = lambda df: df.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "order", "h", "own", F.sha2("body", 256).alias("text_sha256"))
    rows = materialize(number(hashed.withColumn("own", F.lit(""))), "rows")
    groups = materialize(_grouped(rows), "groups")
    bad = materialize(collisions(hashed, groups), "collisions")
    if bad.isEmpty():
        return rows, groups, None
    drop_table(rows)
    drop_table(groups)
    rows = materialize(number(_told_apart(hashed, bad)), "rows")
    return rows, materialize(_grouped(rows), "groups"), bad


def _told_apart(hashed: DataFrame, bad: DataFrame) -> DataFrame:
    """hashed with own: the text of rows whose hash collided, else empty."""
    return hashed.join(bad.withColumn("bad", F.lit(True)), "h", "left").withColumn("own", F.when(F.col("bad"), F.col("body")).otherwise(F.lit(""))).drop("bad")


def duplicates(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: the group of equal texts that it is in.

    Texts are equal if they are after white space is normalised; null counts as empty. The row with the smallest doc_id is
    kept, and keep_id is its id; a null doc_id counts as the largest. Rows that share the smallest id are decided by a hash
    of all columns (but maps), and of rows that agree in all of them one is kept. Every row is one of the result,
    so an empty table has none. digest: the hash that groups rows; the result doesn't depend on it.
    """
    rows, groups, _ = _classes(docs, digest)
    total = rows.count()
    out = met(rows, groups, ["h", "own"], "group_size", total)
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of docs that are kept, with all their columns, as they are; see duplicates()."""
    rows, groups, bad = _classes(docs, digest)
    total = rows.count()
    drop_table(rows)
    h, own, order, size, keep, keep_order = unused(docs, "h", "own", "order", "group_size", "keep_id", "keep_order")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumns({order: F.xxhash64(*[F.col(f"`{c}`") for c in plain]), h: digest(normalised(F.col("text")))})
    if bad is None:
        keyed = keyed.withColumn(own, F.lit(""))
    else:
        (is_bad,) = unused(keyed, "bad")
        keyed = keyed.join(bad.select(F.col("h").alias(h), F.lit(True).alias(is_bad)), h, "left").withColumn(own, F.when(F.col(is_bad), normalised(F.col("text"))).otherwise(F.lit(""))).drop(is_bad)
    found = met(keyed, groups.select(F.col("h").alias(h), F.col("own").alias(own), F.col("group_size").alias(size), F.col("keep_id").alias(keep), F.col("keep_order").alias(keep_order)), [h, own], size, total)
    several = found.where(F.col(size).isNotNull() & F.col("doc_id").cast("long").eqNullSafe(F.col(keep)) & (F.col(order) == F.col(keep_order)))
    # what is left of a group are rows that agree in all columns
    once = several.groupBy(h, own).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(size)).select(f"{size}.*")
    return found.where(F.col(size).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(once)
