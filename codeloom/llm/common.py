"""Helpers shared by the operators: the shared folder, written tables, bounded ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.functions.tables import drop_table, materialize, release, shared_dir, unused  # noqa: F401


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id as long and text with null as empty, plus the named columns; others are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)


def running_total(df: DataFrame, group: list[str], block: str, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the blocks before this one, for each group.

    df has one row for each group and block, so a window holds as many rows as there are blocks
    and not as many as the group has rows.
    """
    by = W.Window.partitionBy(*group).orderBy(block) if group else W.Window.partitionBy(F.lit(0)).orderBy(block)
    return df.withColumn(out, F.coalesce(F.sum(value).over(by.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


#: Keys that hold more than this share of a table's rows are met by a broadcast.
HOT_KEYS = 4096


def met(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """rows left-joined with a table that has each key once. weight, a column of the table: how many of the rows hold the
    key (or more); total: all rows (or more).

    Keys with more than total / HOT_KEYS rows are HOT_KEYS at most, whatever the size of the data, so they can go to all
    executors; their rows aren't shuffled. No other key has many rows for one task.
    """
    hot, rest = table.where(F.col(weight) > total / HOT_KEYS), table.where(F.col(weight) <= total / HOT_KEYS)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, "left")
    return near.select(*far.columns).unionByName(far)


#: Members of one block of an array whose running values are found block by block.
ARRAY_BLOCK = 64


def before(array: str, merge: str = "{a} + {b}", levels: int = 2) -> str:
    """SQL: for each member of a bigint array, what merge makes of the members before it, beginning with 0.

    Each member meets at most a block of others, and the blocks' own values are found in the same way, so the work
    grows with the array and not with its square.
    """
    fold = lambda of, start, k: f"aggregate({of}, {start}, (s{k}, y{k}) -> {merge.format(a=f's{k}', b=f'y{k}')})"
    within = lambda of, start, k: f"transform({of}, (x{k}, i{k}) -> {fold(f'slice({of}, 1, i{k})', start, k)})"
    n = levels
    if not n:
        body = within(f"v{n}", "0L", n)
    else:
        blocks = f"transform(sequence(0L, (size(v{n}) - 1L) div {ARRAY_BLOCK}), k{n} -> slice(v{n}, cast(k{n} * {ARRAY_BLOCK} + 1 as int), {ARRAY_BLOCK}))"
        totals = f"transform(b{n}, c{n} -> {fold(f'c{n}', '0L', f'{n}c')})"
        body = f"flatten(element_at(transform(array({blocks}), b{n} -> zip_with(b{n}, {before(totals, merge, n - 1)}, (d{n}, t{n}) -> {within(f'd{n}', f't{n}', n)})), 1))"
    # in a one-element array an argument is computed once
    return f"element_at(transform(array({array}), v{n} -> {body}), 1)"
