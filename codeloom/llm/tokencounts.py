"""Exact histogram of encoded lengths, and what its suffix sums answer.

Each task counts its documents by encoded length and sends one row for each length, so what is
shuffled and kept has as many rows as there are lengths, however many documents there are. Suffix
sums over the histogram give, for every context limit, how many documents are as long, how many
tokens they hold and how many tokens remain if each document is cut at the limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.bpe import default_path, library_encoder
from codeloom.llm.common import materialize, running_total, texts

#: Lengths in a block of the two-step sums.
BLOCK = 1024


def _counted(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = library_encoder(path)
    found: Counter[int] = Counter()
    for batch in batches:
        found.update(len(own.packed(text.as_py())) // 4 for text in batch.column("text"))
        if len(found) > 100_000:
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())})
            found.clear()
    yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())})


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents are encoded in so many tokens. Null text: 0 tokens.

    Repeated rows count as often as they occur. An empty table has no rows.
    """
    path = path or default_path()
    parts = texts(docs).select("text").mapInArrow(lambda it: _counted(path, it), "n_tokens long, n long")
    return parts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a limit: what lies below it and from it on.

    n_tokens, n_docs, docs_from, tokens_from (this long or longer), docs_up_to, tokens_up_to,
    quantile (share of documents up to this length) and truncated_total (tokens that remain if
    documents are cut at this length).
    """
    rows = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    blocks = running_total(running_total(blocks, [], "block", "block_docs", "docs_before"), [], "block", "block_tokens", "tokens_before")
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumn("all_docs", F.sum("block_docs").over(everything)).withColumn("all_tokens", F.sum("block_tokens").over(everything))
    so_far = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(blocks.drop("block_docs", "block_tokens"), "block")
    rows = rows.withColumn("docs_up_to", F.col("docs_before") + F.sum("n_docs").over(so_far)).withColumn("tokens_up_to", F.col("tokens_before") + F.sum("tokens").over(so_far))
    rows = rows.withColumn("docs_from", F.col("all_docs") - F.col("docs_up_to") + F.col("n_docs")).withColumn("tokens_from", F.col("all_tokens") - F.col("tokens_up_to") + F.col("tokens"))
    return rows.select("n_tokens", "n_docs", "docs_from", "tokens_from", "docs_up_to", "tokens_up_to", (F.col("docs_up_to") / F.col("all_docs")).alias("quantile"), (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"))


def answers(sums: DataFrame, limits: Sequence[int] = (), quantiles: Sequence[float] = ()) -> DataFrame:
    """kind, at, value: truncated totals at any limits and lengths at any quantiles.

    A limit above all lengths keeps all tokens; one below the shortest cuts every document.
    """
    asked = [F.struct(F.lit("truncated_total").alias("kind"), F.lit(float(x)).alias("at"), (F.coalesce(F.max(F.when(F.col("n_tokens") < x, F.col("tokens_up_to"))), F.lit(0)) + F.lit(int(x)) * F.coalesce(F.max(F.when(F.col("n_tokens") >= x, F.col("docs_from"))), F.lit(0))).alias("value")) for x in limits]
    asked += [F.struct(F.lit("length").alias("kind"), F.lit(float(q)).alias("at"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("value")) for q in quantiles]
    return sums.agg(F.array(*asked).alias("asked")).select(F.inline("asked"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The histogram of whole texts with its suffix sums, one row for each length that occurs; see suffix_sums().

    Null and empty texts have length 0, repeated rows count as often as they occur, an empty table gives no
    rows. The histogram is written once, so texts are encoded once however often it is read.
    """
    return suffix_sums(materialize(length_histogram(docs, path), "histogram"))
