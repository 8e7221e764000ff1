"""Statistics of a corpus and of a build, and their report."""

from __future__ import annotations

import html
import json
import string
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as T
from codeloom.functions import vectors as V
from codeloom.operators.metrics import Seen

LARGEST, FILES_SHOWN, FOLDERS_SHOWN = 50, 50, 10


def by(units: DataFrame, key: str, size: str = "size") -> DataFrame:
    """key, n, total size, average size."""
    return units.groupBy(key).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("size")).withColumn("avg_size", V.average("size", "n"))


def sized(units: DataFrame) -> DataFrame:
    return units.withColumn("size", F.length("content").cast("long")).withColumn("language", P.language(P.extension("path")))


def totals(units: DataFrame, size: str = "size") -> DataFrame:
    return units.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size"))


def largest(units: DataFrame, n: int = LARGEST, *, size: str = "size", order: str = "seq") -> DataFrame:
    return units.orderBy(F.col(size).desc(), order).limit(n)


def rolled(units: DataFrame, keys: list[str], k: int = 5, *, size: str = "size", order: str = "seq") -> DataFrame:
    """keys, level, n, size, top, more: for each group, for the groups above it and for all units how many there are, their size, the k
    largest (order and size, the largest first), and how many more there are.

    level has a bit for each key that is left out, the last key's lowest; such keys are null. The k largest of a group are among the k
    largest of its parts, so tasks send k rows of each of their groups, and each level is made from the one below.
    """
    rows = units.select(*keys, F.col(size).cast("long").alias("own"), F.col(order).alias("at"))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("own").alias("size"))
    totals = totals.rollup(*[F.col(c) for c in keys]).agg(F.grouping_id().cast("long").alias("level"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    tops, best = None, rows
    for kept in range(len(keys), -1, -1):
        ranked = F.row_number().over(Window.partitionBy(*(keys[:kept] or [F.lit(0)])).orderBy(F.desc("own"), "at"))
        best = best.withColumn("place", ranked).where(F.col("place") <= k).select(*keys[:kept], *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keys[kept:]], "own", "at")
        level = best.withColumn("level", F.lit((1 << (len(keys) - kept)) - 1).cast("long"))
        tops = level if tops is None else tops.unionByName(level)
    tops = tops.groupBy("level", *keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("own")).alias("less"), "at"))).alias("top"))
    tops = tops.select(F.col("level").alias("at_level"), *[F.col(c).alias(f"at_{c}") for c in keys], F.transform("top", lambda x: F.struct(x["at"].alias("at"), (-x["less"]).alias("size"))).alias("top"))
    same = F.col("level") == F.col("at_level")
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"at_{c}"))
    return totals.join(tops, same).select(*keys, "level", "n", "size", "top", (F.col("n") - F.size("top")).alias("more"))


def file_counts(audit: DataFrame) -> DataFrame:
    """status, skip_reason, n."""
    return audit.groupBy("status", "skip_reason").agg(F.count("*").alias("n"))


def total_files(audit: DataFrame) -> int:
    """Files in the folders that weren't pruned, before any of them is skipped."""
    return audit.count()


def errors(audit: DataFrame) -> DataFrame:
    return audit.where("error_type is not null").groupBy("error_type").agg(F.count("*").alias("n"))


def files_by_extension(audit: DataFrame) -> DataFrame:
    return audit.groupBy("extension").agg(F.count("*").alias("n"))


def document(repository: str, timestamp: str, timings: Mapping[str, float], audit: DataFrame, folders: DataFrame, units: DataFrame, seen: Seen | None = None) -> dict:
    """The report as nested lists and maps: aggregates, and lists that end at their limits. seen: counts that were taken when audit and
    units were written, which then need no job."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    units = sized(units)
    shown = audit.orderBy("rel_path")
    total, states = (seen["files"]["total"], seen.file_counts()) if seen else (total_files(audit), rows(file_counts(audit).orderBy("status", "skip_reason")))
    whole, kinds = ({"n": seen["units"]["n"], "size": seen["units"]["size"]}, seen.unit_counts()) if seen else (rows(totals(units))[0], rows(by(units, "unit_type").orderBy("unit_type")))
    return {
        "repository": repository, "timestamp": timestamp, "timings": dict(timings),
        "file_processing": {"total": total, "counts": states, "extensions": rows(files_by_extension(audit).orderBy("extension")), "processed_files": rows(shown.where("status = 'processed'").select("rel_path", "extension", "size", "n_units").limit(FILES_SHOWN)), "error_files": rows(shown.where("status = 'error'").select("rel_path", "extension", "size", "error", "error_type").limit(FILES_SHOWN)), "errors": rows(errors(audit).orderBy("error_type"))},
        "code_units": {**whole, "by_type": kinds, "by_language": rows(by(units, "language").orderBy("language")), "largest_units": rows(largest(units).select("path", "name", "unit_type", "size", "package", "class_name", F.substring("content", 1, T.PREVIEW_JSON).alias("content")))},
        "folders": {"counts": rows(folders.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")), "skipped": [r["rel_path"] for r in folders.select("rel_path").distinct().orderBy("rel_path").limit(FOLDERS_SHOWN).collect()]},
    }


PAGE = string.Template("<!doctype html><html><head><meta charset='utf-8'><title>Index report: $repository</title></head><body><h1>$repository</h1><p>$timestamp</p>$body</body></html>")


def as_json(report: Mapping) -> str:
    return json.dumps(report, default=str, indent=1)


def as_html(report: Mapping) -> str:
    """A page of tables in which all values are escaped."""
    e = lambda x: html.escape("" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x))

    def table(title: str, rows: list[Mapping]) -> str:
        if not rows:
            return f"<h2>{e(title)}</h2><p>none</p>"
        head = "".join(f"<th>{e(c)}</th>" for c in rows[0])
        return f"<h2>{e(title)}</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td><pre>{e(v)}</pre></td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"

    files, units, folders = report["file_processing"], report["code_units"], report["folders"]
    counted = sum(r["n"] for r in files["counts"] if r["status"] == "processed")
    more = f"<p>... and {counted - FILES_SHOWN} more</p>" if counted > FILES_SHOWN else ""
    body = table("Timings", [{"step": k, "seconds": v} for k, v in report["timings"].items()]) + table("Files", files["counts"]) + table("Extensions", files["extensions"]) + table("Processed", files["processed_files"]) + more + table("Errors", files["error_files"])
    body += f"<p>{e(units['n'])} units, {e(units['size'])} characters</p>" + table("Types", units["by_type"]) + table("Languages", units["by_language"]) + table("Largest", units["largest_units"]) + table("Folders", folders["counts"])
    return PAGE.substitute(repository=e(report["repository"]), timestamp=e(report["timestamp"]), body=body)
