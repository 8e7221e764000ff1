"""Batch plan of embedding calls: batches by position, chunks by estimated tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.tables import materialize, unused
from codeloom.functions.text import TOKENS_PER_TEXT

BATCH = 100
TOKENS_PER_BATCH = 6_000
#: About the rows of one block when positions are counted.
BLOCK = 100_000
#: monotonically_increasing_id() has the partition in the bits from here on, the row's place in it below.
PART = 33


def _ranged(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """rows, written in ranges of about BLOCK rows by the keys, with their number in their range and the range's number above it."""
    (tie,) = unused(rows, "tie")
    plain = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    keys = [*keys, tie]
    ranged = rows.withColumn(tie, F.xxhash64(*plain)).repartitionByRange(max(1, -(-rows.count() // BLOCK)), *keys).sortWithinPartitions(*keys)
    return materialize(ranged.withColumn(index, F.monotonically_increasing_id()).drop(tie), "ranges")


def _above(blocks: DataFrame, block: str, values: dict[str, str]) -> DataFrame:
    """block and, under new names, the sums of the values of the blocks before it."""
    window = Window.partitionBy(F.lit(0)).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(block, *[F.coalesce(F.sum(c).over(window), F.lit(0)).alias(new) for c, new in values.items()])


def positions(rows: DataFrame, order: str, out: str = "pos", then: tuple[str, ...] = ()) -> DataFrame:
    """Adds each row's place, from 0, in the order of a column (and of others within one value); replaces a column of that name.

    Rows are dealt to ranges of about BLOCK rows, as many as they need, sorted there, numbered in their range and written
    once; the sums of the ranges' sizes, one row for each, then go to all tasks. Rows that agree in order and then are told
    apart by a hash of all columns, so only rows that agree in everything must share a range.
    """
    rows = rows.drop(out)
    index, block, before, n = unused(rows, "index", "block", "before", "n")
    written = _ranged(rows, [order, *then], index)
    sizes = _above(written.groupBy(F.shiftright(index, PART).alias(block)).agg(F.count("*").alias(n)), block, {n: before})
    place = F.col(before) + F.col(index).bitwiseAND((1 << PART) - 1)
    return written.withColumn(block, F.shiftright(index, PART)).join(F.broadcast(sizes), block).withColumn(out, place.cast("long")).drop(index, block, before)


def running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each column of whole numbers in sums, under the name given there, its sum over all rows before this one in the order
    of some columns; in two steps, as positions()."""
    names = unused(rows, "index", "block", *[f"before_{out}" for out in sums.values()])
    index, block, before = names[0], names[1], dict(zip(sums, names[2:]))
    written = _ranged(rows.drop(*sums.values()), order, index).withColumn(block, F.shiftright(index, PART))
    blocks = _above(written.groupBy(block).agg(*[F.sum(c).alias(c) for c in sums]), block, before)
    within = Window.partitionBy(block).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    rows = written.join(F.broadcast(blocks), block)
    return rows.withColumns({out: (F.col(before[c]) + F.coalesce(F.sum(c).over(within), F.lit(0))).cast("long") for c, out in sums.items()}).drop(index, block, *before.values())


def plan(rows: DataFrame, order: str, tokens: str, *, batch: int = BATCH, limit: int = TOKENS_PER_BATCH) -> DataFrame:
    """Adds pos, batch, chunk (within the batch), chunk_tokens and single (texts of this chunk go one by one).

    A batch over the limit is cut into chunks of n // (2 * (tokens // limit) + 1) rows, at least one;
    a chunk over what a call takes goes item by item.
    """
    rows = positions(rows, order).withColumn("batch", F.expr(f"pos div {batch}"))
    total, n, size = unused(rows, "total", "n", "size")
    within = Window.partitionBy("batch")
    rows = rows.withColumn(total, F.sum(tokens).over(within)).withColumn(n, F.count("*").over(within))
    cut = F.when(F.col(total) > limit, F.greatest(F.lit(1), F.expr(f"{n} div ({total} div {limit} * 2 + 1)"))).otherwise(F.col(n))
    rows = rows.withColumn(size, cut.cast("long")).withColumn("chunk", F.expr(f"(pos % {batch}) div {size}"))
    rows = rows.withColumn("chunk_tokens", F.sum(tokens).over(Window.partitionBy("batch", "chunk")))
    return rows.withColumn("single", F.col("chunk_tokens") > TOKENS_PER_TEXT).drop(total, n, size)
