"""Repositories as tables: every file with its size and time, and the reason why a file is skipped.

The lister walks folders, in tasks, and never reads contents. It is a data source of its own because
Spark's file sources leave out names that begin with a dot or an underscore. Rules that prune folders
apply while it walks, and so do conditions on columns (path, extension, size, time), which Spark pushes into it; all other
rules are columns, so skipped files are never opened.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from codeloom import schemas
from codeloom.sources import ignore

#: Extensions that are parsed, and those that are never text. Fixed values.
SUPPORTED = (".java", ".py", ".xml")
BINARY = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".beam", ".jar", ".war", ".ear", ".class", ".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib", ".a", ".lib",
    ".exe", ".bin", ".o", ".obj", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".mp3", ".mp4", ".avi", ".mov", ".flv", ".wav",
)

#: Tasks of the lister for each core.
TASKS = 2


class Part(NamedTuple):
    """A folder to list, with or without what is below it; of its entries those whose name falls to one of several shares."""

    folder: str
    below: bool
    share: int
    shares: int


def _pruned(rules: ignore.Ignore, rel: str) -> str | None:
    """Why a folder isn't entered."""
    return "git" if os.path.basename(rel) == ".git" else "ignored" if rules.matches(rel, folder=True) else None


def _folders(root: str, level: list[str], rules: ignore.Ignore, prune: bool) -> Iterator[str]:
    for here in level:
        try:
            with os.scandir(os.path.join(root, here)) as entries:
                for entry in entries:
                    rel = f"{here}/{entry.name}" if here else entry.name
                    if entry.is_dir(follow_symlinks=False) and not (prune and _pruned(rules, rel)):
                        yield rel
        except OSError:
            continue


def parts(root: str, prune: bool, tasks: int, within: str = "") -> list[list[Part]]:
    """What each task lists: the folders of the deepest level that has fewer than so many, in shares, with all below them,
    and the folders above without. Only the names of these folders are held, however large the repository is.

    within: a folder that all wanted files lie below; no other is opened.
    """
    rules = ignore.load(root)
    for n in range(1, within.count("/") + 2) if within else ():
        here = "/".join(within.split("/")[:n])
        at = os.path.join(root, here)
        if os.path.islink(at) or not os.path.isdir(at) or (prune and _pruned(rules, here)):
            return []
    above, level = [], [within]
    while (below := list(itertools.islice(_folders(root, level, rules, prune), tasks))) and len(below) < tasks:
        above, level = above + level, below
    shares = -(-tasks // len(level))
    every = [Part(f, False, 0, 1) for f in above] + [Part(f, True, i, shares) for f in level for i in range(shares)]
    return [every[i::tasks] for i in range(min(tasks, len(every)))]


def walk(root: str, prune: bool, part: Part, start: str = "") -> Iterator[tuple[str, bool, str | None]]:
    """Relative path, whether a rule ignores it, no reason: of each file; of each pruned folder with the reason.

    start: what wanted paths begin with; folders that can't hold such a path aren't entered.
    """
    rules, top = ignore.load(root), os.path.join(root, part.folder)
    for here, names, found in os.walk(top):
        at = os.path.relpath(here, root).replace(os.sep, "/")
        rel = lambda name: name if at == "." else f"{at}/{name}"  # noqa: B023, E731
        own = lambda name: here != top or zlib.crc32(os.fsencode(name)) % part.shares == part.share  # noqa: B023, E731
        keep = []
        for name in filter(own, names):
            if not f"{rel(name)}/".startswith(start) and not start.startswith(f"{rel(name)}/"):
                continue
            reason = _pruned(rules, rel(name)) if prune else None
            if reason:
                yield rel(name), True, reason
            elif part.below:
                keep.append(name)
        names[:] = keep
        for name in filter(own, found):
            yield rel(name), rules.matches(rel(name)), None


def extension(rel_path: str) -> str:
    """As paths.extension()."""
    return os.path.splitext(rel_path.rsplit("/", 1)[-1])[1].lower()


#: Filters that the lister takes over: what a value must be. A null meets none of them but the first two.
TESTS: dict[type, Callable] = {
    IsNull: lambda value, f: value is None,
    Not: lambda value, f: value is not None and not TESTS[type(f.child)](value, f.child),
    IsNotNull: lambda value, f: value is not None,
    EqualTo: lambda value, f: value is not None and value == f.value,
    In: lambda value, f: value is not None and value in f.value,
    GreaterThan: lambda value, f: value is not None and value > f.value,
    GreaterThanOrEqual: lambda value, f: value is not None and value >= f.value,
    LessThan: lambda value, f: value is not None and value < f.value,
    LessThanOrEqual: lambda value, f: value is not None and value <= f.value,
    StringStartsWith: lambda value, f: value is not None and value.startswith(f.value),
    StringEndsWith: lambda value, f: value is not None and value.endswith(f.value),
    StringContains: lambda value, f: value is not None and f.value in value,
}
#: Columns that are known before a file's size and time are asked for.
FREE = ("path", "rel_path", "extension", "ignored", "reason")


def _taken(f: Filter) -> bool:
    """Whether the lister can take a filter over; doubles that aren't numbers compare in another way in Python."""
    if isinstance(f, Not):
        return type(f.child) in TESTS and not isinstance(f.child, (Not, IsNull, IsNotNull)) and _taken(f.child)
    values = f.value if isinstance(f, In) else [getattr(f, "value", 0)]
    return type(f) in TESTS and len(f.attribute) == 1 and all(v is not None and v == v for v in values)


def _column(f: Filter) -> str:
    return (f.child if isinstance(f, Not) else f).attribute[0]


def _meets(filters: list[Filter], row: dict) -> bool:
    return all(TESTS[type(f)](row[_column(f)], f) for f in filters)


class _Parts(InputPartition):
    def __init__(self, parts: list[Part]):
        self.parts = parts


class _Reader(DataSourceReader):
    """Filters act while folders are walked: one on the beginning of rel_path decides which folders are opened, those on names
    which files are asked for their size and time, and those on these which rows are sent."""

    def __init__(self, root: str, prune: bool, tasks: int):
        self.root, self.prune, self.tasks, self.filters = root, prune, tasks, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _taken(f):
                self.filters.append(f)
            else:
                yield f

    @property
    def start(self) -> str:
        """The longest beginning that all wanted paths have."""
        return max((f.value for f in self.filters if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("rel_path",)), key=len, default="")

    def partitions(self):
        return [_Parts(p) for p in parts(self.root, self.prune, self.tasks, self.start.rpartition("/")[0])] or [_Parts([])]

    def read(self, partition: _Parts) -> Iterator[tuple]:
        free = [f for f in self.filters if _column(f) in FREE]
        rest = [f for f in self.filters if _column(f) not in FREE]
        for rel, ignored, reason in itertools.chain.from_iterable(walk(self.root, self.prune, p, self.start) for p in partition.parts):
            row = {"path": os.path.join(self.root, rel), "rel_path": rel, "size": None, "mtime": None, "ignored": ignored, "reason": reason, "extension": extension(rel)}
            if not _meets(free, row):
                continue
            if reason is None:
                with contextlib.suppress(OSError):
                    stat = os.stat(row["path"])
                    row["size"], row["mtime"] = int(stat.st_size), float(stat.st_mtime)
            if _meets(rest, row):
                yield tuple(row.values())


class RepositorySource(DataSource):
    """format("repository"), options path, prune ("false": every file, .git and ignored ones too) and tasks. Pruned folders
    are rows with a reason. Spark asks it to filter only with spark.sql.python.filterPushdown.enabled set."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, rel_path string, size long, mtime double, ignored boolean, reason string, extension string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("prune", "true") != "false", int(self.options.get("tasks", "8")))


def _rows(spark: SparkSession, root: str, prune: bool) -> DataFrame:
    spark.dataSource.register(RepositorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    tasks = TASKS * spark.sparkContext.defaultParallelism
    return spark.read.format("repository").option("path", root).option("prune", str(prune).lower()).option("tasks", str(tasks)).load()


def walked(spark: SparkSession, root: str) -> DataFrame:
    """One walk: a row for each file, and, with a reason, for each folder that isn't entered."""
    return _rows(spark, root, True)


def files(walk: DataFrame) -> DataFrame:
    """path, rel_path, extension, size, mtime, ignored of the files of a walk."""
    return walk.where("reason is null").drop("reason")


def pruned(walk: DataFrame) -> DataFrame:
    """rel_path, reason of the folders that a walk didn't enter."""
    return walk.where("reason is not null").select(*schemas.names(schemas.FOLDERS))


def listing(spark: SparkSession, root: str, prune: bool = True) -> DataFrame:
    """path, rel_path, extension, size, mtime, ignored of the files below root."""
    return files(_rows(spark, root, prune))


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, mtime, size of every file, without any rule."""
    return listing(spark, root, prune=False).select("rel_path", "mtime", "size")


def folders(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, reason of the pruned folders."""
    return pruned(walked(spark, root))


def dealt(files: DataFrame) -> DataFrame:
    """Listed files dealt evenly to tasks: folders differ in size, and moving names costs little beside reading files."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rel_path")


def skip_reason(extension: Column | str, ignored: Column | str | None = None) -> Column:
    """Why a file is skipped: ignored, binary, unsupported, in this order; null if it is not."""
    e = F.col(extension) if isinstance(extension, str) else extension
    hidden = F.lit(False) if ignored is None else F.col(ignored) if isinstance(ignored, str) else ignored
    return F.when(hidden, "ignored").when(e.isin(*BINARY), "binary").when(~e.isin(*SUPPORTED), "unsupported")


def read_text(path: str) -> str:
    """Text of a file: UTF-8, else Latin-1; line ends become \\n; a byte order mark stays."""
    with open(path, "rb") as file:
        data = file.read()
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def contents(files: DataFrame) -> DataFrame:
    """path, rel_path, extension, size, content, error, error_type; a file that can't be read has an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                text = error = kind = None
                try:
                    text = read_text(row.path)
                except Exception as why:
                    error, kind = str(why), type(why).__name__
                yield pd.DataFrame({"path": [row.path], "rel_path": [row.rel_path], "extension": [row.extension], "size": [row.size], "content": [text], "error": [error], "error_type": [kind]})

    return dealt(files.select("path", "rel_path", "extension", "size")).mapInPandas(run, "path string, rel_path string, extension string, size long, content string, error string, error_type string")
