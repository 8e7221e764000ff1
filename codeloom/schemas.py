"""Schemas of the tables, as DDL."""

from __future__ import annotations

FILE_META = "rel_path string, mtime double, size long"
FOLDERS = "rel_path string, reason string"
CACHE = "content_hash string, model string, dimensions int, vector array<float>"
CATALOG = "index_name string, repo_name string, path_hash string, commit string, is_modified boolean, repo_path string, indexed_on timestamp, n_units long, dimensions int, incremental boolean, model string, location string, cache_ref string, cache_entries long"
HISTORY = "query string, ts timestamp"

#: What identifies a unit; content doesn't, and null equals null.
IDENTITY = ["path", "name", "unit_type", "package", "class_name"]


def names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]
