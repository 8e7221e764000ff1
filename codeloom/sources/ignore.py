"""Ignore rules of a repository's root: patterns with *, ?, [], **, a leading or trailing slash and !."""

from __future__ import annotations

import os
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Pattern(NamedTuple):
    regex: str
    negated: bool
    folders_only: bool


def compiled(line: str) -> Pattern | None:
    """One line as an expression over paths; None for blank lines and comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    if line.startswith(("\\#", "\\!")):
        line = line[1:]
    folders_only = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    parts = line.strip("/").split("/")
    if not any(parts):
        return None
    out = "" if anchored else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
        else:
            out += _part(part) + ("" if last else "/")
    return Pattern(f"^{out}$", negated, folders_only)


def _part(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
            while i + 1 < len(part) and part[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := part.find("]", i + 2)) > 0:
            body = part[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return out


class Ignore:
    """The last pattern that matches decides. A pattern that matches a folder covers what is in it."""

    def __init__(self, lines: list[str]):
        self.patterns = [p for line in [".git/", *lines] if (p := compiled(line))]
        self._regex = [re.compile(p.regex) for p in self.patterns]

    def matches(self, rel_path: str, folder: bool = False) -> bool:
        parts = rel_path.strip("/").split("/")
        found = False
        for pattern, regex in zip(self.patterns, self._regex):
            for n in range(1, len(parts) + 1):
                if (n < len(parts) or folder or not pattern.folders_only) and regex.match("/".join(parts[:n])):
                    found = not pattern.negated
                    break
        return found


def ignored(rel_path: Column, rules: Ignore) -> Column:
    """The same for files as a column: the last pattern that covers the path or a folder above it decides."""
    found = F.lit(None).cast("boolean")
    for p in rules.patterns:
        below = "/.*" if p.folders_only else "(?:/.*)?"
        found = F.when(F.rlike(rel_path, F.lit(f"(?s){p.regex[:-1]}{below}$")), F.lit(not p.negated)).otherwise(found)
    return F.coalesce(found, F.lit(False))


def load(root: str) -> Ignore:
    """The rules of .gitignore in the root; without the file, or if it can't be read, only .git/."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as file:
            return Ignore(file.read().splitlines())
    except OSError:
        return Ignore([])
