"""Encoding, length histogram and packing against the tokenizers library and plain Python."""

import bisect
import collections
import hashlib
import random
import struct
import unicodedata
import zlib

import pytest
import tokenizers

from codeloom.llm import bpe, packing, queries, tokencounts

from .conftest import odd_texts


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_pieces_are_those_of_the_pattern_for_all_characters(library):
    for first in range(0, 0x110000, 997):
        chars = [chr(c) for c in range(first, min(first + 997, 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join("a" + c + " " + c + "1" + c + "\n" for c in chars[::3])
        assert bpe.split_words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_encodes_and_decodes_as_the_library(library):
    own = bpe.Encoder(bpe.default_path(), remembered=200)
    rng = random.Random(3)
    parts = [*"abst're've'd'll'm  \n\t\r.!1²é日🙂‍ 　", "<|endoftext|>", "the", " th", "  ", "aaaa"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + [c * n for c in ("a", "-", "ab", " ", "\n", " a", "é") for n in range(1, 40)]
    for text in [*texts, *(t for t in odd_texts() if t)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_the_other_library_gives_the_same_ids_for_all_characters(library):
    own = bpe.LibraryEncoder(bpe.default_path())
    for first in range(0, 0x110000, 4999):
        text = "".join("a" + chr(c) + " " + chr(c) + "1" + chr(c) + "\n" for c in range(first, min(first + 4999, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert own.packed(text) == struct.pack(f"<{len(ids)}I", *ids) if (ids := library.encode(text, add_special_tokens=False).ids) else not text
    for text in ("", " " * 100_000 + "x", "<|endoftext|> a", *(t for t in odd_texts() if t)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.packed(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_query_digests(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_odd_rows(odd, empty):
    assert bpe.token_digests(odd).count() == odd.count()
    assert bpe.token_digests(empty).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert collections.Counter(r.text for r in back) == collections.Counter(r.text or "" for r in odd.collect())


def test_length_histogram(spark, sf_dir, library, odd, empty):
    lengths = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows = queries.op8_token_counts(spark, sf_dir).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        n = r.n_tokens
        assert (r.n_docs, r.docs_from, r.tokens_from) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.docs_up_to, r.tokens_up_to, r.truncated_total) == (bisect.bisect_right(lengths, n), sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths))
    sums = tokencounts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {(r.kind, r.at): r.value for r in tokencounts.answers(sums, [1, 500, 10**6], [0.5, 1.0]).collect()}
    assert got["truncated_total", 500.0] == sum(min(x, 500) for x in lengths) and got["truncated_total", 1e6] == sum(lengths) and got["truncated_total", 1.0] == sum(min(x, 1) for x in lengths)
    assert got["length", 1.0] == lengths[-1] and got["length", 0.5] == lengths[(len(lengths) + 1) // 2 - 1]
    assert tokencounts.token_counts(odd).agg({"n_docs": "sum"}).first()[0] == odd.count()
    assert tokencounts.token_counts(empty).count() == 0


def check_packing(rows, docs, library, capacity=2048):
    """docs: Counter of (doc_id, text)."""
    want = collections.Counter()
    for (d, text), times in docs.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        at, end, piece = 0, n % capacity or capacity, 0
        while at < n:
            want[d, piece, at, end - at, zlib.crc32(struct.pack(f"<{end - at}I", *ids[at:end]))] += times
            at, end, piece = end, end + capacity, piece + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark, sf_dir, library, odd, empty):
    docs = collections.Counter((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    n, least = check_packing(queries.op4_packing(spark, sf_dir).collect(), docs, library)
    assert n <= least * 1.05 + 1
    check_packing(packing.pack(odd).collect(), collections.Counter((r.doc_id, r.text) for r in odd.collect()), library)
    check_packing(packing.pack(odd, capacity=16).collect(), collections.Counter((r.doc_id, r.text) for r in odd.collect()), library, 16)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 300): rng.randint(1, 500) for _ in range(rng.randint(1, 200))}
    plan = packing.Plan(counts, 300, 12)
    for length, n in counts.items():
        assert sorted(k for s in plan.segments if s.length == length for k in range(s.rank_from, s.rank_from + s.n)) == list(range(n))
    assert plan.sequences <= -(-sum(k * n for k, n in counts.items()) // 300) * 1.25 + 2


def test_unicode_table_is_later_than_the_interpreters():
    assert bpe.classes()[0x105C0] == bpe.LETTER and unicodedata.category("A") == "Lu"
