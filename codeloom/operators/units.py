"""Files to code units."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.extract import erlang, java, python
from codeloom.functions import paths as P
from codeloom.functions import text as T
from codeloom.functions.tables import materialize, unused
from codeloom.operators import batching
from codeloom.sources import repository

#: Scanner by extension; other files are one unit each.
SCANNERS: dict[str, Callable[[str], list]] = {".java": java.units, ".py": python.units}
OPTIONAL = {".erl": erlang.units}
#: Files that have no unit of their own beside what is found in them.
WITHOUT_FILE = (".java",)

ROWS_AT_ONCE = 500

UNIT = "path string, rel_path string, extension string, size long, pos int, content string, unit_type string, name string, package string, class_name string, error string, error_type string"


def of_text(rel_path: str, text: str, scanners: dict[str, Callable] | None = None) -> tuple[list[tuple], Exception | None]:
    """(type, name, content, class) of a file, and what went wrong; a file that can't be scanned is still one unit."""
    ext = os.path.splitext(rel_path)[1].lower()
    scan = (SCANNERS if scanners is None else scanners).get(ext)
    out = [] if ext in WITHOUT_FILE else [("file", os.path.basename(rel_path), text, None)]
    try:
        return out + (scan(text) if scan else []), None
    except Exception as why:  # a scanner's error must not end the job
        return out, why


def parse(files: DataFrame, *, erlang_too: bool = False) -> DataFrame:
    """Rows of units of the listed files, and one row with an error and no unit for a file that failed.

    Long methods and functions are cut; files and class stubs are not. pos orders the units of a file.
    """
    scanners = SCANNERS | (OPTIONAL if erlang_too else {})

    def scan(row) -> list[tuple]:
        try:
            text = repository.read_text(row.path)
        except Exception as why:
            return _rows(row, [], why)
        return _rows(row, *of_text(row.rel_path, text, scanners))

    return _cut(repository.dealt(files.select("path", "rel_path", "extension", "size")).mapInPandas(lambda it: _scanned(scan, it), UNIT))


def parse_texts(texts: DataFrame, *, erlang_too: bool = False) -> DataFrame:
    """The same for rows rel_path, content, which any source may give."""
    scanners = SCANNERS | (OPTIONAL if erlang_too else {})

    def scan(row) -> list[tuple]:
        return _rows(row, *of_text(row.rel_path, row.content, scanners))

    rows = texts.select(F.col("rel_path").alias("path"), "rel_path", P.extension("rel_path").alias("extension"), F.octet_length("content").cast("long").alias("size"), F.coalesce("content", F.lit("")).alias("content"))
    return _cut(rows.mapInPandas(lambda it: _scanned(scan, it), UNIT))


def _scanned(scan: Callable, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, out = [x.split()[0] for x in UNIT.split(", ")], []
    for part in parts:
        for row in part.itertuples(index=False):
            out += scan(row)
            if len(out) >= ROWS_AT_ONCE:
                yield pd.DataFrame(out, columns=columns)
                out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def _rows(row, found: list[tuple], why: Exception | None) -> list[tuple]:
    folder = os.path.dirname(row.rel_path).replace("/", ".") or None
    file = (row.path, row.rel_path, row.extension, row.size)
    out = [(*file, pos, content, kind, name, folder, owner, None, None) for pos, (kind, name, content, owner) in enumerate(found)]
    if why is not None or not found:
        out.append((*file, len(found), None, None, None, folder, None, *((str(why), type(why).__name__) if why else (None, None))))
    return out


def _cut(rows: DataFrame) -> DataFrame:
    cut = F.when(F.col("unit_type").isin("method", "function"), T.truncate_unit("content")).otherwise(F.col("content"))
    return rows.withColumn("content", cut)


def _at() -> Column:
    # U+0001 keeps the units of a folder together, before those of folders whose names go on
    return F.concat(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1), F.lit("\x01"), "rel_path")


def placed(parsed: DataFrame) -> DataFrame:
    """Rows of units with seq: their place by folder, file and position."""
    rows = parsed.where("unit_type is not null")
    (at,) = unused(rows, "at")
    return batching.positions(rows.withColumn(at, _at()), at, "seq", ("pos",)).drop(at)


def counted(parsed: DataFrame) -> DataFrame:
    """rel_path, n, first, last of each file with units: how many it has, and the bounds of their pos. Reads no contents."""
    own = parsed.where("unit_type is not null").select("rel_path", "pos")
    return materialize(own.groupBy("rel_path").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last")), "counted")


def starts(counts: DataFrame) -> DataFrame:
    """rel_path, start: what a unit's pos is taken to for its place by folder, file and position."""
    rows = batching.running(counts.withColumn("at", _at()), ["at"], {"n": "before"})
    return rows.select("rel_path", (F.col("before") - F.col("first")).alias("start"))


def numbered(parsed: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Units with seq and unit_id, both their place. parsed is read several times, so it should be a written table.

    Files are counted and put in order by name, and their units follow from where each file starts (given, if parsed is only a part of
    the units), so contents move once at most, and stay where they are if parsed is in buckets by rel_path. Files that several
    rows share a pos of are put in order unit by unit.
    """
    if start is None:
        counts = counted(parsed)
        start = starts(counts) if counts.where("n <> last - first + 1").isEmpty() else None
    if start is None:
        rows = placed(parsed)
    else:
        rows = parsed.where("unit_type is not null").join(start.hint("shuffle_hash"), "rel_path").withColumn("seq", (F.col("start") + F.col("pos")).cast("long"))
    return rows.select(F.col("seq").alias("unit_id"), "seq", F.col("rel_path").alias("path"), "content", "unit_type", "name", "package", "class_name", T.content_hash("content").alias("content_hash"))


def audit(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """One status for each file: processed, skipped with a reason, or error."""
    got = parsed.groupBy("rel_path").agg(F.count("unit_type").alias("n_units"), F.max("error").alias("error"), F.max("error_type").alias("error_type"))
    rows = files.join(got, "rel_path", "left")
    status = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("error_type").isNotNull(), "error").otherwise("processed")
    return rows.select("path", "rel_path", "extension", "size", status.alias("status"), "skip_reason", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), "error", "error_type")
