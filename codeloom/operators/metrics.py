"""Counts that are taken while a table is written, so that they cost no job of their own.

Each is a column of one aggregate that Spark computes over the rows as they pass (DataFrame.observe), so keys must be known beforehand: the
states of files, the reasons for skipping them and the kinds of units are; extensions and languages are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

STATES = (("processed", None), ("error", None), ("skipped", "ignored"), ("skipped", "binary"), ("skipped", "unsupported"))
KINDS = ("file", "class", "method", "function")


class Seen:
    """What has been counted on the way; a count is there once its table has been written."""

    def __init__(self):
        self.taken: dict[str, Observation] = {}

    def watch(self, rows: DataFrame, name: str, counts: dict[str, Column]) -> DataFrame:
        """rows, to be written: their counts are then known by name."""
        self.taken[name] = Observation(name)
        return rows.observe(self.taken[name], *[value.alias(key) for key, value in counts.items()])

    def __getitem__(self, name: str) -> dict:
        return self.taken[name].get

    def files(self, audit: DataFrame) -> DataFrame:
        of = lambda status, reason: F.count_if((F.col("status") == status) & F.col("skip_reason").eqNullSafe(F.lit(reason)))
        return self.watch(audit, "files", {"total": F.count(F.lit(1)), "tried": F.coalesce(F.sum("n_units"), F.lit(0))} | {f"{s}.{r or ''}": of(s, r) for s, r in STATES})

    def units(self, units: DataFrame) -> DataFrame:
        size = F.length("content").cast("long")
        kind = lambda k: F.when(F.col("unit_type") == k, size)
        counts = {"n": F.count(F.lit(1)), "size": F.coalesce(F.sum(size), F.lit(0))}
        for k in KINDS:
            counts |= {f"n.{k}": F.count(kind(k)), f"size.{k}": F.coalesce(F.sum(kind(k)), F.lit(0))}
        return self.watch(units, "units", counts)

    def file_counts(self) -> list[dict]:
        """As report.file_counts()."""
        rows = [{"status": s, "skip_reason": r, "n": self["files"][f"{s}.{r or ''}"]} for s, r in STATES]
        return sorted((r for r in rows if r["n"]), key=lambda r: (r["status"], r["skip_reason"] or ""))

    def unit_counts(self) -> list[dict]:
        """As report.by() of unit_type."""
        own = self["units"]
        return [{"unit_type": k, "n": own[f"n.{k}"], "size": own[f"size.{k}"], "avg_size": round(own[f"size.{k}"] / own[f"n.{k}"], 2)} for k in sorted(KINDS) if own[f"n.{k}"]]
