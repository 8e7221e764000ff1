"""Functions of an Erlang file; off unless asked for."""

from __future__ import annotations

import re

from codeloom.extract.java import covered

Unit = tuple[str, str, str, str | None]

_OPAQUE = re.compile(r'"(?:[^"\\]++|\\.)*+"|\'(?:[^\'\\]++|\\.)*+\'|%[^\n]*|\$\\?.', re.S)
_HEAD = re.compile(r"\s*([a-z][A-Za-z0-9_@]*|'(?:\\.|[^'\\])*')\s*\(", re.S)


def units(text: str) -> list[Unit]:
    """Forms that begin with a name and a parenthesis, up to the full stop that ends them."""
    code = _OPAQUE.sub(lambda m: m[0] if m[0][0] == "'" else covered(m[0], " "), text)
    out, begin = [], 0
    for stop in re.finditer(r"\.(?=\s|\Z)", code):
        if found := _HEAD.match(code, begin):
            first = found.start(1)
            out.append(("function", found[1], text[first : stop.end()], None))
        begin = stop.end()
    return out
