"""Code units of a Python file."""

from __future__ import annotations

import ast
import re

Unit = tuple[str, str, str, str | None]
DEF = (ast.FunctionDef, ast.AsyncFunctionDef)
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")


def _source(lines: list[str], node: ast.AST) -> str:
    """As ast.get_source_segment(), of a text that is split into lines (with their ends) only once; columns count bytes."""
    first, last = node.lineno - 1, node.end_lineno - 1
    if first == last:
        return lines[first].encode()[node.col_offset : node.end_col_offset].decode()
    return "".join([lines[first].encode()[node.col_offset :].decode(), *lines[first + 1 : last], lines[last].encode()[: node.end_col_offset].decode()])


def _parameters(lines: list[str], node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    """Parameters as they are written: the text between the parentheses, cut at its own commas."""
    body = _source(lines, node)
    at = body.index("(", body.index("def"))
    out, depth, now, quote, i = [], 0, "", "", at
    while i < len(body):
        c = body[i]
        if quote:
            now += c
            if c == "\\":
                i += 1
                now += body[i : i + 1]
            elif body.startswith(quote, i):
                now += quote[1:]
                i += len(quote) - 1
                quote = ""
        elif c in "\"'":
            quote = c * 3 if body.startswith(c * 3, i) else c
            now += quote
            i += len(quote) - 1
        elif c == "#":
            while i + 1 < len(body) and body[i + 1] != "\n":
                i += 1
        elif c in "([{":
            depth += 1
            now += c if depth > 1 else ""
        elif c in ")]}":
            depth -= 1
            if not depth:
                break
            now += c
        elif c == "," and depth == 1:
            out.append(now.strip())
            now = ""
        else:
            now += c
        i += 1
    return [p for p in [*out, now.strip()] if p]


def _fields(node: ast.ClassDef) -> list[str]:
    found: list[str] = []
    for item in node.body:
        if isinstance(item, ast.Assign):
            found += [t.id for t in item.targets if isinstance(t, ast.Name)]
        elif isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
            found.append(item.target.id)
    return found


def _stub(lines: list[str], node: ast.ClassDef) -> str:
    bases = [_source(lines, b) for b in node.bases] + [_source(lines, k) or f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords]
    head = f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}"
    methods = [f"{m.name}({', '.join(_parameters(lines, m))})" for m in node.body if isinstance(m, DEF)]
    return "\n".join([f"{head}: ... {{", *(f"  {x}" for x in _fields(node) + methods), "}"])


def units(text: str, decorated: bool = True) -> list[Unit]:
    """(type, name, content, class) of the classes, methods and functions at the top level.

    A class is a stub of its fields and methods. Decorated definitions count unless decorated is false. Raises SyntaxError.
    """
    out: list[Unit] = []
    lines = _LINE.findall(text)
    for node in ast.parse(text).body:
        if not isinstance(node, (ast.ClassDef, *DEF)) or (node.decorator_list and not decorated):
            continue
        if isinstance(node, ast.ClassDef):
            out.append(("class", node.name, _stub(lines, node), None))
            out += [("method", m.name, _source(lines, m), node.name) for m in node.body if isinstance(m, DEF) and (decorated or not m.decorator_list)]
        else:
            out.append(("function", node.name, _source(lines, node), None))
    return out
