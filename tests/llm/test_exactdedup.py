"""Exact duplicates against plain Python."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm import exactdedup


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(repr((d, least[k := re.sub(r"[\x20\x09-\x0d]+", " ", t or "")], len(groups[k]))) for d, t in rows)


@pytest.mark.parametrize("digest", [exactdedup.content_hash, lambda body: F.unhex(F.hex(F.length(body) % 3)), lambda body: F.unhex(F.lit("00"))])
def test_odd_rows(odd, digest):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows += [(100, "a  b"), (99, "a\t\nb"), (101, " a b"), (102, "a b")]
    df = odd.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("own", F.lit(1)).repartition(3)
    out = exactdedup.duplicates(df, digest).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size)) for r in out) == expected(rows)
    texts = {re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows}
    assert sum(r.kept for r in out) == len(texts)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    stay = exactdedup.deduplicated(df, digest)
    assert stay.columns == df.columns
    assert sorted(re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "") for r in stay.collect()) == sorted(texts)


def test_the_same_row_stays_however_rows_are_dealt(spark):
    rows = [(1, "x y", "a"), (1, "x  y", "b"), (1, "x y", "c"), (2, "x y", "a")] * 3
    found = {repr(exactdedup.deduplicated(spark.createDataFrame(rows[::way], "doc_id long, text string, source string").repartition(n)).collect()) for n in (1, 3) for way in (1, -1)}
    assert len(found) == 1


def test_long_and_hot(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("hot text "), 2000)).otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    out = exactdedup.duplicates(rows)
    assert [tuple(r) for r in out.groupBy("kept", "group_size").count().orderBy("kept", "group_size").collect()] == [(False, 1000, 999), (True, 1, 2000), (True, 1000, 1)]


def test_empty(empty):
    assert exactdedup.duplicates(empty).count() == 0
    assert exactdedup.deduplicated(empty).count() == 0


def test_sql(same_as_sql, sf_dir):
    same_as_sql("op13_exact_dedup", sf_dir)
