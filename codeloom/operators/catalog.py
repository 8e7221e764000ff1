"""Catalog of index versions."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions.tables import drop_table, materialize


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.col("indexed_on").desc_nulls_last(), "index_name")


def displayed(catalog: DataFrame) -> DataFrame:
    """name, full_name, git_version and an ISO time for lists; versions without a commit have no git_version."""
    name = P.display_name(F.col("repo_name"), F.col("path_hash"), F.col("commit"), F.col("is_modified"))
    short = F.when(F.col("commit").isNotNull(), F.concat(F.left("commit", F.lit(8)), F.when(F.col("is_modified"), F.lit(" (modified)")).otherwise(F.lit(""))))
    return catalog.select(F.col("repo_name").alias("name"), name.alias("full_name"), short.alias("git_version"), F.date_format("indexed_on", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "index_name", "indexed_on")


def reusable(catalog: DataFrame, repo_name: str, path_hash: str, commit: str | None) -> DataFrame:
    """The newest version of the repository at another commit; none outside git."""
    if commit is None:
        return catalog.limit(0)
    other = catalog.where((F.col("repo_name") == repo_name) & (F.col("path_hash") == path_hash) & F.col("commit").isNotNull() & (F.col("commit") != commit))
    return newest_first(other).limit(1)


def latest_by_repository(catalog: DataFrame) -> DataFrame:
    """The newest row of each repository; ties by index name."""
    newest = F.max_by(F.struct(*catalog.columns), F.struct("indexed_on", "index_name"))
    return catalog.groupBy("repo_name", "path_hash").agg(newest.alias("r")).select("r.*")


def nearest_indexed(graph: DataFrame, indexed: DataFrame, asked: DataFrame) -> DataFrame:
    """commit, ancestor, steps: of each asked commit the ancestor with an index to which the fewest steps lead; of several the one
    indexed last, then the smaller commit. Commits without such an ancestor have no row.

    graph: commit, parent (a merge has several rows). indexed: commit, indexed_on. Answers go down the graph, a step at a time: what is
    nearest to a commit is nearest to one of its parents too, or is that parent. So each commit is answered once, and the edges
    above it are then left out, however many commits are asked. Only a commit that would be its own ancestor, in a graph with
    cycles, goes up the graph for itself.
    """
    known = indexed.where("commit is not null").groupBy(F.col("commit").alias("parent")).agg((-F.unix_micros(F.max("indexed_on").cast("timestamp"))).alias("less"))
    held = materialize(known.select("parent", F.struct("less", F.col("parent").alias("ancestor")).alias("best")), "indexed")
    edges = materialize(graph.where("commit is not null and parent is not null").select("commit", "parent").distinct(), "edges")
    found, last = None, held
    for steps in itertools.count(1):
        met = materialize(edges.join(last, "parent").groupBy("commit").agg(F.min("best").alias("best")), "met")
        if met.isEmpty():
            break
        one = met.select("commit", "best.ancestor", F.lit(steps).alias("steps"))
        found = one if found is None else found.unionByName(one)
        rest = materialize(edges.join(met, "commit", "left_anti"), "edges")
        drop_table(edges)
        edges, last = rest, met.withColumnRenamed("commit", "parent").join(held.select("parent"), "parent", "left_anti")
    if found is None:
        return _gone_up(graph, indexed, asked.limit(0))
    answers = materialize(asked.where("commit is not null").select("commit").distinct().join(found, "commit"), "answers")
    own = answers.where("commit = ancestor").select("commit")
    if own.isEmpty():
        return answers
    return answers.where("commit <> ancestor").unionByName(_gone_up(graph, indexed, own))


def _gone_up(graph: DataFrame, indexed: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for few commits: all go up the graph together, a step at a time, each until it meets an index other than its own; a
    commit that is reached in two ways goes on once."""
    newest = materialize(indexed.groupBy(F.col("commit").alias("at")).agg(F.max("indexed_on").alias("indexed_on")), "indexed")
    edges = graph.where("commit is not null and parent is not null").select(F.col("commit").alias("at"), "parent").distinct()
    up = asked.where("commit is not null").select("commit", F.col("commit").alias("at")).distinct()
    seen, found = up, None
    for steps in itertools.count(1):
        up = materialize(up.join(edges, "at").select("commit", F.col("parent").alias("at")).distinct().join(seen, ["commit", "at"], "left_anti"), "up")
        if up.isEmpty():
            break
        best = F.min_by(F.col("at"), F.struct(-F.unix_micros(F.col("indexed_on").cast("timestamp")), "at"))
        met = materialize(up.join(newest, "at").groupBy("commit").agg(best.alias("ancestor")).withColumn("steps", F.lit(steps)), "met")
        found = met if found is None else found.unionByName(met)
        seen = materialize(seen.join(met, "commit", "left_anti").unionByName(up.join(met, "commit", "left_anti")), "seen")
        up = up.join(met, "commit", "left_anti")
    return found if found is not None else asked.sparkSession.createDataFrame([], f"commit {asked.schema['commit'].dataType.simpleString()}, ancestor {asked.schema['commit'].dataType.simpleString()}, steps int")
