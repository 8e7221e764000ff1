"""Texts before they are embedded or shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() has it.
BLANK = r"^[\s\x0b\x1c-\x1f\x85\p{Z}]*$"
PLACEHOLDER = "placeholder_text_for_embedding"
EMPTY = "empty_content"
TEXT_CUT = 25_000
UNIT_CUT = 4_000
TOKENS_PER_TEXT = 8_000
PREVIEW_CONSOLE, PREVIEW_JSON = 200, 1_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used, also in branches."""
    return F.element_at(F.transform(F.array(value), use), 1)


def content_hash(text: Column | str) -> Column:
    return F.md5(_c(text))


def to_text(value: Column | str) -> Column:
    return F.coalesce(_c(value).cast("string"), F.lit(""))


def is_blank(text: Column | str) -> Column:
    return F.rlike(_c(text), F.lit(BLANK))


def token_estimate(text: Column | str) -> Column:
    """No tokens in no text, else a third of its characters and two."""
    n = F.length(_c(text))
    return F.when(n == 0, F.lit(0)).otherwise(F.floor(n / 3) + 2).cast("long")


def sanitize(text: Column | str) -> Column:
    """Control characters become spaces (not tab and line ends); invisible marks go; null is empty."""
    spaced = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{D800}-\x{DFFF}]", " ")
    return F.regexp_replace(spaced, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]", "")


def sanitize_aggressive(text: Column | str) -> Column:
    """Printable ASCII without quotes and backslashes, single spaces."""
    ascii_ = F.regexp_replace(sanitize(text), r"[^\x00-\x7F]", " ")
    plain = F.regexp_replace(F.regexp_replace(ascii_, r"[\s\x0b]+", " "), r"""[\\"'\x00-\x1f\x7f-\x9f]""", " ")
    return _once(plain, lambda p: F.when(is_blank(p), F.lit(EMPTY)).otherwise(p))


def sanitize_extreme(text: Column | str) -> Column:
    """Letters, numbers and single spaces."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[^\p{L}\p{N}\s\p{Z}]", " "), r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "))
    return _once(plain, lambda p: F.when(p == "", F.lit(PLACEHOLDER)).otherwise(p))


def prepare(text: Column | str) -> Column:
    """What is sent to an embedder: cut, sanitized, a placeholder if blank, plain ASCII if still long."""
    clean = sanitize(F.substring(to_text(text), 1, TEXT_CUT))
    filled = _once(clean, lambda c: F.when(is_blank(c), F.lit(PLACEHOLDER)).otherwise(c))
    return _once(filled, lambda f: F.when(token_estimate(f) > TOKENS_PER_TEXT, sanitize_aggressive(f)).otherwise(f))


def truncate(text: Column | str, limit: int, mark: str) -> Column:
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(mark))).otherwise(t)


def truncate_unit(text: Column | str) -> Column:
    return truncate(text, UNIT_CUT, "... [content truncated]")


def preview(text: Column | str, limit: int = PREVIEW_CONSOLE) -> Column:
    return truncate(text, limit, "...")


def decode(content: Column | str) -> Column:
    """Bytes as UTF-8 if they are valid, else as Latin-1; line ends become \\n; a byte order mark stays."""
    c = _c(content)
    text = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.decode(c, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")
