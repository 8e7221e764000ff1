"""Secret scans with a trigram index, in DataFrame and SQL functions alone.

Each rule is a regular expression. From its syntax follows a Boolean query of trigrams that every match must
hold: an OR of sets, each of which is an AND. The index has postings (trigram, document) for the trigrams
that the queries ask for, in lower case; intersecting the postings gives each rule's candidates, and only these
are verified with the expression. A rule that must hold no trigram is verified on every document.

Places come from the text between the matches: the lengths of these parts and of the matches before add up, block by
block, so a text with very many matches costs no more than its length.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import before, unused

#: A character class with more members than this is anything; so are more strings than MOST_STRINGS.
MOST_MEMBERS = 4
MOST_STRINGS = 64
REDACTED = "[REDACTED]"


class Rule(NamedTuple):
    """kind, expression, and if it can't say itself how long a match must be: the group that is measured and the
    characters that it must have. A match that is too short still takes its characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Runs are taken whole, so a run that is long enough is found whether or not shorter ones count as matches before.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
#: Code points of the parts that a text is cut into when spans are replaced.
PART = 1024


def _members(parts: list) -> set[str] | None:
    out: set[str] = set()
    for op, value in parts:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < MOST_MEMBERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_MEMBERS else None


def _and(one: set[frozenset[str]], two: set[frozenset[str]]) -> set[frozenset[str]]:
    return _least({a | b for a in one for b in two})


def _least(clauses: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without the sets that hold another set, which that one stands for."""
    return {c for c in clauses if not any(d < c for d in clauses)}


ANY: set[frozenset[str]] = {frozenset()}


def _of_strings(strings: set[str]) -> set[frozenset[str]]:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _walk(parts) -> tuple[set[str] | None, set[frozenset[str]]]:
    """All strings of a sequence if they are few, else None; and the query of what it must hold."""
    query, exact, whole = ANY, {""}, True
    for op, value in parts:
        own: set[str] | None = None
        inner = ANY
        if op is C.LITERAL:
            own = {chr(value).lower()}
        elif op is C.IN:
            own = _members(value)
        elif op is C.SUBPATTERN:
            own, inner = _walk(value[3])
        elif op is C.BRANCH:
            found = [_walk(x) for x in value[1]]
            own = set().union(*(f[0] for f in found)) if all(f[0] is not None for f in found) else None
            inner = _least(set().union(*(f[1] for f in found)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            once, inner = _walk(body)
            if high == 1 and once is not None:
                own = once | ({""} if not low else set())
            elif not low:
                inner = ANY
        if own is not None and len({a + b for a in exact for b in own}) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in own}
            continue
        query = _and(query, _of_strings(exact))
        query = _and(query, inner if own is None else _of_strings(own))
        exact, whole = {""}, False
    return (exact if whole else None), _and(query, _of_strings(exact))


def trigram_query(pattern: str) -> set[frozenset[str]] | None:
    """An OR of ANDs of lower-case trigrams without which nothing matches; None if there is none."""
    query = _walk(parser.parse(pattern))[1]
    return None if frozenset() in query else query


def matches(rule: Rule, when: Column | None = None) -> Column:
    """Lengths of a rule's matches in text, leftmost and not overlapping, of their measured groups, and of the gaps around
    them: an array of one struct, or of none if there is no match or the condition doesn't hold."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    sizes = lambda parts: F.transform(parts, lambda x: F.length(x).cast("bigint"))
    group = lambda n: sizes(F.regexp_extract_all(text, pattern, F.lit(n)))
    owns = group(rule.group) if rule.least else F.array().cast("array<bigint>")
    found = F.array(F.struct(sizes(F.split(text, rule.pattern, -1)).alias("gaps"), group(0).alias("sizes"), owns.alias("owns")))
    test = F.regexp_like(text, pattern)
    return F.when(test if when is None else when & test, found).otherwise(F.array().cast("array<struct<gaps:array<bigint>,sizes:array<bigint>,owns:array<bigint>>>"))


def spans_of(rule: Rule, rank: int, found: str) -> str:
    """SQL for array<struct<start, rank, kind, end>> of the matches in a column of matches() that are long enough, by start."""
    # a match begins behind the first gap and all matches before it, each with the gap that follows
    starts = before("zip_with(f.sizes, slice(f.gaps, 2, size(f.sizes)), (a, b) -> a + b)")
    spans = f"transform({starts}, (t, i) -> named_struct('start', f.gaps[0] + t, 'rank', {rank}, 'kind', '{rule.kind}', 'end', f.gaps[0] + t + f.sizes[i]))"
    if rule.least:
        spans = f"filter({spans}, (m, i) -> f.owns[i] >= {rule.least})"
    return f"flatten(transform({found}, f -> {spans}))"


def postings(docs: DataFrame, grams: list[str], key: str) -> DataFrame:
    """The inverted index: gram (its number) and key of each document that holds it, for these trigrams."""
    low = docs.select(key, F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select(key, F.explode(held).alias("gram"))


def candidates(posts: DataFrame, grams: list[str], queries: dict[int, set[frozenset[str]]], key: str, out: str) -> DataFrame:
    """key and out, the numbers of the rules whose queries hold: postings intersected by document."""
    number = {g: i for i, g in enumerate(grams)}
    words = range(len(grams) // 60 + 1)
    masks = posts.groupBy(key).agg(*[F.bit_or(F.when(F.expr(f"gram div 60 = {w}"), F.expr("shiftleft(1L, gram % 60)")).otherwise(0)).alias(f"mask{w}") for w in words])

    def holds(clause: frozenset[str]) -> str:
        need = [sum(1 << number[g] % 60 for g in clause if number[g] // 60 == w) for w in words]
        return "(" + " and ".join(f"mask{w} & {n}L = {n}L" for w, n in enumerate(need) if n) + ")"

    rules = F.array_compact(F.array(*[F.when(F.expr(" or ".join(sorted(map(holds, q)))), F.lit(i)) for i, q in queries.items()]))
    return masks.select(key, rules.alias(out)).where(F.size(out) > 0)


def found_spans(docs: DataFrame, spans: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs plus a column spans, sorted by start and then by rule: array<struct<start, rank, kind, end>>.

    Null texts have none. The index knows a row by a hash of its doc_id and text, so no id, null or not, is a hot key;
    rows that share a hash share candidates, which verification sorts out.
    """
    key, named, *each = unused(docs, "key", "rules", *(f"found{i}" for i in range(len(rules))))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for clause in q for g in clause})
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    if queries:
        keyed = keyed.join(candidates(postings(keyed, grams, key), grams, queries, key, named), key, "left")
    else:
        keyed = keyed.withColumn(named, F.lit(None).cast("array<int>"))
    keyed = keyed.withColumns({c: matches(r, F.coalesce(F.array_contains(named, i), F.lit(False)) if i in queries else None) for i, (r, c) in enumerate(zip(rules, each))})
    every = F.array_sort(F.concat(*[F.expr(spans_of(r, i, f"`{c}`")) for i, (r, c) in enumerate(zip(rules, each))]))
    return keyed.select(*docs.columns, every.alias(spans))


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base rules' spans), spans (of all rules).

    Starts and ends count code points. Null text is empty and has none. One row for each input row,
    repeated rows too, in no order; a null doc_id stays null; an empty table has no rows.
    """
    rows = found_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "found", rules)
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    base = f"filter(found, s -> s.rank < {len(BASE)})"
    return rows.select("doc_id", *counts, F.expr(f"sha2({_listed(base)}, 256)").alias("base_sha256"), F.expr(_listed("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of a rule replaced by REDACTED in text; overlapping spans by one. Null stays null.

    All columns and rows stay, whatever their names; only text changes.
    """
    (spans,) = unused(docs, "spans")
    rows = found_spans(docs, spans, rules)
    # the text in parts of PART code points; what lies between two places is put together from them
    between = f"array_join(transform(if(from < to, sequence(from div {PART}, (to - 1) div {PART}), cast(array() as array<bigint>)), k -> substring(p[cast(k as int)], cast(greatest(from - k * {PART}, 0) + 1 as int), cast(least(to - k * {PART}, {PART}) - greatest(from - k * {PART}, 0) as int))), '')"
    piece = lambda start, end: between.replace("from", start).replace("to", end)
    kept = f"transform(e, (at, i) -> if(s[i].start >= at, concat({piece('at', 's[i].start')}, '{REDACTED}'), ''))"
    last = "greatest(e[size(e) - 1], s[size(s) - 1].end)"
    ends = before("transform(s, x -> x.end)", "greatest({a}, {b})")
    whole = f"array_join(concat({kept}, array({piece(last, 'n')})), '')"
    joined = f"transform(array(`{spans}`), s -> element_at(transform(array({ends}), e -> element_at(transform(array(regexp_extract_all(text, '(?s).{{1,{PART}}}', 0)), p -> element_at(transform(array(cast(length(text) as bigint)), n -> {whole}), 1)), 1)), 1))"
    return rows.withColumn("text", F.expr(f"if(size(`{spans}`) > 0, element_at({joined}, 1), text)")).select(*docs.columns)


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str, int]]:
    """The same spans by trying every rule on the text, for tests."""
    text = text or ""
    return sorted((m.start(), i, r.kind, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text, re.ASCII) if len(m.group(r.group)) >= r.least)
