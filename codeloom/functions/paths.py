"""Paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def relative(path: Column | str, root: str) -> Column:
    """Path below root, which may end with a slash."""
    return F.substr(_c(path), F.lit(len(root.rstrip("/")) + 2))


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Last dot of the name and what follows, in lower case; dots that begin a name don't count."""
    return F.lower(F.regexp_extract(_c(path), r"^(?:.*/)?\.*[^/.][^/]*?(\.[^./]*)$", 1))


def package(rel_path: Column | str) -> Column:
    """Folder with dots for slashes; null at the root."""
    p = _c(rel_path)
    return F.when(F.contains(p, F.lit("/")), F.replace(F.regexp_extract(p, "^(.*)/[^/]*$", 1), F.lit("/"), F.lit(".")))


def language(ext: Column | str) -> Column:
    e = _c(ext)
    return F.when(e == "", F.lit("unknown")).otherwise(F.substr(e, F.lit(2)))


def safe_name(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"[^\p{L}\p{N}]", "_")


def path_hash(repo_path: Column | str) -> Column:
    return F.left(F.md5(_c(repo_path)), F.lit(8))


def index_version(commit: Column | str, modified: Column | str) -> Column:
    """The commit, with -latest behind it if the tree was changed; null outside git."""
    return F.when(_c(modified), F.concat(_c(commit), F.lit("-latest"))).otherwise(_c(commit))


def display_name(repo_name: Column, hashed: Column, commit: Column, modified: Column) -> Column:
    """name (hash) @ commit: eight characters of it, or all and (modified); no commit, no @."""
    head = F.concat(repo_name, F.lit(" ("), hashed, F.lit(")"))
    return F.when(commit.isNull(), head).when(modified, F.concat(head, F.lit(" @ "), commit, F.lit(" (modified)"))).otherwise(F.concat(head, F.lit(" @ "), F.left(commit, F.lit(8))))


#: Names that a page's highlighter has for extensions. Fixed values.
HIGHLIGHT = {
    "java": "java", "py": "python", "js": "javascript", "ts": "typescript", "kt": "kotlin", "go": "go", "rs": "rust", "scala": "scala", "swift": "swift", "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp", "erl": "erlang", "hrl": "erlang", "html": "html", "css": "css",
    "xml": "xml", "json": "json", "md": "markdown", "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash", "yml": "yaml", "yaml": "yaml", "sql": "sql", "dart": "dart", "ex": "elixir", "exs": "elixir", "hs": "haskell", "lua": "lua", "pl": "perl", "r": "r",
}


def highlight_language(path: Column | str) -> Column:
    """By what follows the last dot of the path; empty if no name is known."""
    known = F.create_map(*[F.lit(x) for pair in HIGHLIGHT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(_c(path), ".", -1))), F.lit(""))
