"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A stage's result is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import langid, linededup, neardup, packing, secretscan
from codeloom.llm.common import materialize, unused


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs; n_chars follows the text, if there is such a column."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return changed.select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that aren't held out; documents whose text has no language
    (null, or without a letter) go, all others stay as they are."""
    # the answer goes beside the columns of docs under a name that none of them has
    named = docs.select(*[F.col(c).alias(f"__{c}") for c in docs.columns], F.coalesce("text", F.lit("")).cast("string").alias("text"))
    model = langid.learn(docs)
    if model.langs and langid.UNKNOWN not in model.langs:
        kept = langid.predict(named, model).where(F.col("lang_pred") != langid.UNKNOWN)
    else:  # the answer und doesn't tell texts without a language from others
        kept = langid.lettered(named)
    return kept.select(*[F.col(f"__{c}").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; every document stays, if need be with an empty text, also a null one."""
    return _with_text(docs, linededup.deduplicate_lines(docs, counts=False))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; a null id counts as the largest.

    Every row is a document: rows that share a doc_id but not the text stand for themselves, and of rows that agree in
    doc_id and text the one whose columns come first in order stays. Documents without words are in no group, and all stay. A kept row keeps all its columns.
    """
    found = neardup.written_groups(docs)
    at_id, at_key, key = unused(docs, "at_id", "at_key", "text_key")
    named = [F.col("doc_id").alias(at_id), F.col("text_key").alias(at_key)]
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(at_id)) & (F.col(key) == F.col(at_key))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = keyed.join(found.where("not kept").select(*named).distinct(), same, "left_anti")
    again = found.where("kept and n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(*named)
    if not again.isEmpty():  # rows that are repeated word for word
        ordered = F.struct(*[c for c, kind in docs.dtypes if "map<" not in kind])
        once = kept.join(again, same, "left_semi").groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), ordered).alias(at_id)).select(f"{at_id}.*")
        return kept.join(again, same, "left_anti").select(*docs.columns).unionByName(once)
    return kept.select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return _with_text(docs, secretscan.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, dealt to sequences: one row for each piece."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Learning and encoding are beyond SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
