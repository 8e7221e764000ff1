"""Code units of a Java file, from a scanner that knows strings, comments and brackets.

A copy of the text with the insides of comments, strings, characters and text blocks blanked out has the
same places as the text, so declarations are found in the copy and read from the text.
"""

from __future__ import annotations

import re

Unit = tuple[str, str, str, str | None]

#: The first form of a text block gives nothing back, so it is read in one go; the second one is for blocks that end in what looks escaped.
_OPAQUE = re.compile(r'"""(?:[^"\\]++|\\.|"(?!""))*+"""|"""(?:\\.|(?!""").)*"""|"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)*+\'|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_CLASS = re.compile(r"\bclass\s+([^\W\d]\w*)")
_NAME = r"[^\W\d]\w*"
_METHOD = re.compile(rf"({_NAME})\s*\(")
_ANNOTATION = re.compile(rf"@\s*(?!interface\b){_NAME}(?:\s*\.\s*{_NAME})*")
_MODIFIER = re.compile(r"\s*(?:public|protected|private|static|final|abstract|native|synchronized|transient|volatile|strictfp|default|sealed|non-sealed)\b")
_OPEN = "([{"
_BRACKET, _PART, _MEMBER, _VALUE = re.compile(r"[()\[\]{}]"), re.compile(r"[()\[\]{}<>,]"), re.compile(r"[(\[=;{]"), re.compile(r"[;(\[{]")
_SPACE = re.compile(r"\s*")


def blanked(text: str) -> str:
    return _OPAQUE.sub(lambda m: covered(m[0], " ") if m[0].startswith("/") else '"' + covered(m[0][1:-1], "_") + '"', text)


def covered(text: str, mark: str) -> str:
    """The mark for each character but line ends."""
    return "\n".join(mark * len(line) for line in text.split("\n"))


def _closing(code: str, at: int) -> int:
    """Place of the bracket that closes the one at a place; the end if it is never closed."""
    depth = 0
    for found in _BRACKET.finditer(code, at):
        if found[0] in _OPEN:
            depth += 1
        else:
            depth -= 1
            if not depth:
                return found.start()
    return len(code)


def _split(code: str, start: int, end: int) -> list[tuple[int, int]]:
    """Parts between commas that stand outside all brackets, angle brackets too."""
    out, depth, begin = [], 0, start
    for found in _PART.finditer(code, start, end):
        i, c = found.start(), found[0]
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and code[i - 1] != "-"):
            depth -= 1
        elif c == "," and not depth:
            out.append((begin, i))
            begin = i + 1
    return [*out, (begin, end)] if code[begin:end].strip() else out


def _after_modifiers(code: str, start: int, end: int) -> int:
    """Where the type begins: behind annotations, modifiers and type parameters."""
    i = start
    while i < end:
        if code[i].isspace():
            i = _SPACE.match(code, i, end).end()
        elif code[i] == "@" and (m := _ANNOTATION.match(code, i)):
            i = m.end()
            j = i + len(code[i:end]) - len(code[i:end].lstrip())
            if j < end and code[j] == "(":
                i = _closing(code, j) + 1
        elif m := _MODIFIER.match(code, i):
            i = m.end()
        elif code[i] == "<":
            depth = 0
            while i < end:
                depth += (code[i] == "<") - (code[i] == ">")
                i += 1
                if not depth:
                    break
        else:
            break
    return i


def _members(code: str, start: int, end: int) -> list[tuple[int, int, int | None]]:
    """(start, end, brace): declarations in a body; the brace that opens its block, if it has one."""
    out, i, begin = [], start, start
    while found := _MEMBER.search(code, i, end):
        i, c = found.start(), found[0]
        if c in "([":
            i = _closing(code, i)
        elif c == "=":  # an initializer ends at its semicolon, whatever blocks are in it
            while (value := _VALUE.search(code, i, end)) and value[0] != ";":
                i = _closing(code, value.start()) + 1
            i = value.start() if value else max(i, end)
            out.append((begin, min(i + 1, end), None))
            begin = i + 1
        elif c == ";":
            out.append((begin, i + 1, None))
            begin = i + 1
        elif c == "{":
            close = min(_closing(code, i), end)
            out.append((begin, min(close + 1, end), i))
            i = close
            begin = i + 1
        i += 1
    return out


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _class_unit(text: str, code: str, begin: int, brace: int, end: int) -> list[Unit]:
    found = _CLASS.search(code, begin, brace)
    name = found[1]
    head = f"class {name}"
    clauses = re.split(r"\b(extends|implements|permits)\b", code[_skip_angles(code, found.end(), brace) : brace])
    for word, what in zip(clauses[1::2], clauses[2::2]):
        if word != "permits":
            head += f" {word} " + ", ".join(_clean(what[a:b]) for a, b in _split(what, 0, len(what)))
    fields, methods, out = [], [], []
    for a, b, block in _members(code, brace + 1, end):
        kind_at = _after_modifiers(code, a, b)
        stop = block if block is not None else b - 1
        equals = code.find("=", kind_at, stop)
        called = _METHOD.search(code, kind_at, stop if equals < 0 else equals)
        if re.match(r"(?:class|interface|enum|record)\b(?!\s*\()|@\s*interface\b", code[kind_at:b]):
            continue
        if called:
            returns = _clean(text[kind_at : called.start()])
            if not returns:
                continue  # a constructor
            close = _closing(code, called.end() - 1)
            params = [p for x, y in _split(code, called.end(), close) if (p := _parameter(text, code, x, y))]
            methods.append(f"  {returns} {called[1]}({', '.join(params)})")
            first = a + len(code[a:b]) - len(code[a:b].lstrip())
            out.append(("method", called[1], text[first:b].rstrip(), name))
        elif block is None and code[kind_at:stop].strip():
            fields += _field_lines(text, code, kind_at, stop)
    return [("class", name, "\n".join([f"{head}: ... {{", *fields, *methods, "}"]), None), *out]


def _skip_angles(code: str, at: int, end: int) -> int:
    at = max(at, _SPACE.match(code, at, end).end())
    if at < end and code[at] == "<":
        depth = 0
        while at < end:
            depth += (code[at] == "<") - (code[at] == ">")
            at += 1
            if not depth:
                break
    return at


def _parameter(text: str, code: str, a: int, b: int) -> str | None:
    """Type and name; parameters of variable number aren't listed."""
    at = _after_modifiers(code, a, b)
    return None if "..." in code[at:b] else _clean(text[at:b])


def _field_lines(text: str, code: str, at: int, stop: int) -> list[str]:
    """A line with type and name for each variable of a declaration."""
    parts = _split(code, at, stop)
    names = []
    for a, b in parts:
        equals = code.find("=", a, b)
        names.append(_clean(text[a : equals if equals >= 0 else b]))
    found = re.match(rf"(.*?)\s*({_NAME})\s*((?:\[\s*\]\s*)*)$", names[0], re.S)
    if not found or not found[1]:
        return []
    kind = found[1]
    return [f"  {kind} {re.match(_NAME, n)[0]}" for n in [found[2], *names[1:]] if re.match(_NAME, n)]


def units(text: str) -> list[Unit]:
    """(type, name, content, class) of the top-level classes and their methods. Nested classes, interfaces,
    enums, records and constructors give none; overloads are units of their own. Never raises."""
    code = blanked(text)
    out: list[Unit] = []
    for a, b, brace in _members(code, 0, len(code)):
        if brace is not None and re.match(r"class\b", code[_after_modifiers(code, a, brace) : brace]):
            end = b - 1 if code[b - 1 : b] == "}" else b
            out += _class_unit(text, code, a, brace, end)
    return out
