"""What changed between two listings of a repository, and the units that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.operators import batching


def changes(current: DataFrame, previous: DataFrame, key: str = "rel_path") -> DataFrame:
    """key, change: new, modified, unchanged or deleted, by time and size."""
    c, p = current.select(key, "mtime", "size", F.lit(True).alias("here")).alias("c"), previous.select(key, "mtime", "size", F.lit(True).alias("here")).alias("p")
    same = F.col("c.mtime").eqNullSafe(F.col("p.mtime")) & F.col("c.size").eqNullSafe(F.col("p.size"))
    change = F.when(F.col("p.here").isNull(), "new").when(F.col("c.here").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return c.join(p, key, "full_outer").select(key, change.alias("change"))


def change_counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("change").agg(F.count("*").alias("n"))


def kept_units(units: DataFrame, changed: DataFrame, *, unit_key: str = "path", key: str = "rel_path") -> DataFrame:
    """Units of files that neither went nor changed; exact paths, not prefixes."""
    gone = changed.where("change in ('deleted', 'modified', 'new')").select(F.col(key).alias(unit_key))
    return units.join(gone, unit_key, "left_anti")


def merged_units(units: DataFrame, changed: DataFrame, fresh: DataFrame, *, unit_key: str = "path", key: str = "rel_path") -> DataFrame:
    return kept_units(units, changed, unit_key=unit_key, key=key).unionByName(fresh)


def _share(n: str, of: str, before: str, base: str) -> Column:
    """How many of a row's n are among the first so many (of) of its group, if before - base of the group's come before it."""
    return F.greatest(F.lit(0), F.least(F.col(n), F.col(of) - (F.col(before) - F.col(base))))


def unit_changes(current: DataFrame, previous: DataFrame, identity: list[str] | None = None, content: str = "content_hash") -> DataFrame:
    """identity, content, change, n: how many copies of a content are unchanged, changed, moved, new or gone between two tables of units.

    A unit is its identity (nulls are equal) and its content's hash; several copies count. Copies that both sides have are unchanged. Of
    what is left, as many as an identity has on both sides have changed, those with the smallest hashes first. What is then left on
    one side is moved if the other has left the same content under another identity, in the order of identities; the
    rest is new, or gone. All rows name what is there now, but for those that are gone.

    Counts are combined before they are shuffled, and shares follow from running sums over ranges, so neither an identity nor a content
    that very many rows have meets in one task.
    """
    identity = identity or schemas.IDENTITY
    side = lambda df, now, then: df.select(*identity, F.col(content).alias("hash"), F.lit(now).alias("now"), F.lit(then).alias("then"))
    both = side(current, 1, 0).unionByName(side(previous, 0, 1)).groupBy(*identity, "hash").agg(F.sum("now").alias("now"), F.sum("then").alias("then"))
    both = both.withColumn("same", F.least("now", "then")).withColumn("plus", F.col("now") - F.col("same")).withColumn("minus", F.col("then") - F.col("same")).drop("now", "then")
    both = both.withColumn("unit", F.md5(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"})))

    def shared(rows: DataFrame, order: list[str], by: str, out: str) -> DataFrame:
        """Adds out and out_gone: the shares of plus and minus that the group by has on both sides; takes them off."""
        rows = batching.running(rows, order, {"plus": "plus_before", "minus": "minus_before"})
        groups = rows.groupBy(by).agg(F.least(F.sum("plus"), F.sum("minus")).alias("common"), F.min("plus_before").alias("plus_base"), F.min("minus_before").alias("minus_base")).where("common > 0")
        rows = rows.join(groups, by, "left").fillna(0, ["common", "plus_base", "minus_base"])
        rows = rows.withColumn(out, F.when(F.col("common") > 0, _share("plus", "common", "plus_before", "plus_base")).otherwise(0)).withColumn("off", F.when(F.col("common") > 0, _share("minus", "common", "minus_before", "minus_base")).otherwise(0))
        return rows.withColumn("plus", F.col("plus") - F.col(out)).withColumn("minus", F.col("minus") - F.col("off")).drop("common", "plus_before", "minus_before", "plus_base", "minus_base", "off")

    rows = shared(both, [*identity, "hash"], "unit", "changed")
    rows = shared(rows, ["hash", *identity], "hash", "moved")
    kinds = F.array(*[F.struct(F.lit(kind).alias("change"), F.col(c).cast("long").alias("n")) for kind, c in (("unchanged", "same"), ("changed", "changed"), ("moved", "moved"), ("new", "plus"), ("gone", "minus"))])
    return rows.select(*identity, F.col("hash").alias(content), F.inline(F.filter(kinds, lambda k: k["n"] > 0)))
