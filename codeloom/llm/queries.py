"""The operators of this subpackage applied to whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, chat, exactdedup, fingerprints, langid, lexical, linededup, media, neardup, packing, prefixtrie, secretscan, tokencounts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_rows(_table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return linededup.deduplicate_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_chat, op3_language_id, op4_packing, op5_line_dedup, op6_media, op7_fingerprints, op8_token_counts, op9_secrets, op10_near_dedup, op11_prefix_trie, op12_lexical_search, op13_exact_dedup)}

ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2_SQL = f"""
WITH turns AS (
    SELECT conv_id, conv_id // 2 AS pair, coalesce(role, '{chat.NO_ROLE}') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations
), last AS (SELECT conv_id, max(i) FILTER (role = '{chat.TRAINED}') AS answer, max(i) AS n FROM turns GROUP BY conv_id),
rejected AS (
    SELECT t.conv_id, t.i, t.role, t.text FROM turns t JOIN last l USING (conv_id) WHERE l.answer IS NULL OR t.i < l.answer
    UNION ALL
    SELECT l.conv_id, l.answer + o.i - p.answer, o.role, o.text FROM last l JOIN last p ON p.conv_id = xor(l.conv_id, 1)
    JOIN turns o ON o.conv_id = p.conv_id AND o.i >= p.answer WHERE l.answer IS NOT NULL
), differ AS (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.i, r.i)) AS at
    FROM turns c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.i = r.i
    WHERE c.i IS NULL OR r.i IS NULL OR c.role <> r.role OR c.text <> r.text GROUP BY 1
), shared AS (SELECT l.conv_id, coalesce(d.at - 1, l.n) AS n_common FROM last l LEFT JOIN differ d USING (conv_id)),
sides AS (SELECT 'c' AS side, conv_id, i, role, text FROM turns UNION ALL SELECT 'r', * FROM rejected),
rendered AS (
    SELECT side, s.conv_id, i, role, n_common, i <= n_common AS before, '{chat.BEGIN}' || role || chr(10) || text || '{chat.END}' || chr(10) AS body,
           length(role) + {len(chat.BEGIN + chat.MIDDLE)} AS lead, length(text) + {len(chat.END)} AS counted
    FROM sides s JOIN shared USING (conv_id)
), placed AS (
    SELECT *, lead + coalesce(sum(length(body)) OVER (PARTITION BY side, conv_id, before ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rendered
)
SELECT s.conv_id, s.n_common,
    coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND before), '') AS prompt,
    coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND NOT before), '') AS chosen,
    coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'r' AND NOT before), '') AS rejected,
    coalesce(string_agg(start::BIGINT || ':' || (start + counted)::BIGINT, ',' ORDER BY i) FILTER (side = 'c' AND NOT before AND role = '{chat.TRAINED}'), '') AS chosen_mask,
    coalesce(string_agg(start::BIGINT || ':' || (start + counted)::BIGINT, ',' ORDER BY i) FILTER (side = 'r' AND NOT before AND role = '{chat.TRAINED}'), '') AS rejected_mask
FROM shared s LEFT JOIN placed p ON p.conv_id = s.conv_id GROUP BY s.conv_id, s.n_common
"""

OP5_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT r, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM docs
), keyed AS (SELECT *, translate(trim(line, {WHITE}), {ASCII_LOWER}) AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {linededup.LIMIT}),
marked AS (SELECT k.r, k.i, k.line, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked m JOIN docs d USING (r) GROUP BY m.r, d.doc_id
"""


def _spans_sql(rules: tuple[secretscan.Rule, ...]) -> str:
    """Spans of each rule in documents: rank, kind, start and end."""
    parts = []
    for rank, rule in enumerate(rules):
        pattern = rule.pattern.replace("\\x20", " ").replace("'", "''")
        if "(?i:" in pattern:  # letters in either case, and no others that fold to them
            head, rest = pattern.split("(?i:", 1)
            words, rest = rest.split(")", 1)
            pattern = head + "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest
        parts.append(f"""
            SELECT r, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(whole) + 1), lambda i: {{
                'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda m: length(m))), 0),
                'size': length(whole[i]), 'own': length(own[i])}})) AS s
            FROM (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS whole, {f"regexp_extract_all(text, '{pattern}', {rule.group})" if rule.group else "whole"} AS own, string_split_regex(text, '{pattern}') AS gaps FROM docs WHERE regexp_matches(text, '{pattern}'))""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    return f"SELECT r, rank, kind, s.start::BIGINT AS start, (s.start + s.size)::BIGINT AS stop FROM ({' UNION ALL '.join(parts)}) WHERE s.own >= CASE rank {least} END"


OP9_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
spans AS ({_spans_sql(secretscan.RULES)}),
listed AS (
    SELECT r, {", ".join(f"count(*) FILTER (kind = '{x.kind}') AS n_{x.kind}" for x in secretscan.BASE)},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(secretscan.BASE)}) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in secretscan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
"""

OP10_SQL = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {ASCII_LOWER}), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {neardup.PERCENT} * (a.n + b.n - count(*))
), reach AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.node) AS component_id, s.doc_id = min(r.node) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""

#: The unsigned CRC-32 of a list of bytes, bit by bit.
NEXT_SQL = "xor(s, CASE WHEN i % 8 = 0 THEN bytes[i // 8 + 1] ELSE 0 END)"
CRC32_SQL = f"xor(4294967295::BIGINT, list_reduce(range(0, 8 * len(bytes)), lambda s, i: xor({NEXT_SQL} >> 1, CASE WHEN {NEXT_SQL} & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT))"

OP11_SQL = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, {CRC32_SQL} % {prefixtrie.HEADS} AS h FROM (
        SELECT conv_id, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT) AS bytes FROM (SELECT DISTINCT conv_id FROM turns))
), rebuilt AS (
    SELECT c.conv_id, t.i, t.role, t.text, 0 AS part FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % {prefixtrie.SPREAD} AND t.i <= c.h
    UNION ALL SELECT c.conv_id, t.i, t.role, t.text, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h
), lists AS (
    SELECT c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY part, i) FILTER (r.conv_id IS NOT NULL), []) AS s FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id
), prefixes AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS d, s FROM lists),
nodes AS (
    SELECT s[1:d] AS seq, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends FROM prefixes GROUP BY 1, 2
), counted AS (
    SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(regexp_split_to_array(seq[depth].text, '[ \\x09-\\x0D]+'), lambda w: w <> '')) END AS saved FROM nodes
), children AS (SELECT seq[1:depth - 1] AS up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
    SELECT b.seq[1:u] AS top, u, sum(saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS u FROM counted) b LEFT JOIN children c ON c.up = b.seq GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1] LEFT JOIN children c ON c.up = n.seq JOIN below b ON b.top = n.seq
"""

OP12_SQL = f"""
WITH found AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, {ASCII_LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)),
tf AS (SELECT r, doc_id, t, count(*) AS tf FROM found GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
docs AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r), whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
asked AS (SELECT i, item_id, unnest(regexp_extract_all(translate(text, {ASCII_LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM (SELECT item_id, text, row_number() OVER () AS i FROM benchmark)),
weighted AS (SELECT i, item_id, t, count(*) * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (t), whole GROUP BY i, item_id, t, df, n_docs),
scored AS (
    SELECT i, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM weighted JOIN tf USING (t) JOIN docs USING (r), whole GROUP BY i, item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INT AS rank FROM scored WHERE score > 0) WHERE rank <= {lexical.TOP}
"""

OP13_SQL = """
WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256 FROM docs
"""

#: Encoding, learning, packing, media files and signatures are beyond SQL; tests/llm holds those queries against plain Python.
ORACLE_SQL: dict[str, str] = {"op2_chat": OP2_SQL, "op5_line_dedup": OP5_SQL, "op9_secrets": OP9_SQL, "op10_near_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_exact_dedup": OP13_SQL}
