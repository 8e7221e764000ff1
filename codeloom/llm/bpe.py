"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton whose arcs carry tokens and whose
paths are exactly the token sequences that byte-pair encoding can produce. It starts as one state
with an arc to itself for each byte. The gadget of a merge (u, v) does two things: the arcs labelled u get
a new target, a copy of the old one that has no arc v; and each state with an arc u gets an arc uv
that leads where v led. All arcs with the same label lead to the same state, so an automaton of
50,000 merges is a few integers for each state and token: a copied state keeps the merge that made it
and the arc it lost; an arc that is younger than its state exists there just if its left part does.

Every string has one path. encode() finds it from left to right: in the state reached at each
position it tries the tokens that the bytes there spell, longest first, follows the first arc that
exists, and steps back from a dead end. The automaton is deterministic over tokens: a state has at most one arc with
a label, and arcs are fixed when the last merge is compiled; they are only read off the tables when first met. Bytes don't say
how long the next token is, so a walk may try several. Words that were met before come from a bounded table of
whole paths. decode() emits the labels of arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codeloom.llm.common import texts

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Letters and numbers that Unicode 16.0 added, which the tokenizers library knows. Fixed values.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Words whose paths a worker remembers: about 150 bytes each.
REMEMBERED = 600_000
#: Arcs that a worker keeps once it has read them from the tables: about 100 bytes each.
READ_ARCS = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def split_words(text: str) -> list[str]:
    """The pieces that the byte-level pattern cuts a text into, found on arrays of classes.

    A run of one class is a piece; a single space joins the run behind it; other white space before
    a run stands alone; an apostrophe that begins a piece takes an English ending with it.
    """
    n = len(text)
    if n < 2:
        return [text] if n else []
    code = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[code]
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    after = np.flatnonzero(cut[1:] & (kind[:-1] == SPACE)) + 1
    cut[after - 1] = True
    cut[after] = code[after - 1] != 0x20
    marks = np.flatnonzero((code == 0x27) & cut)
    for p in marks.tolist():
        for ending in CONTRACTIONS:
            if text.startswith(ending, p + 1):
                cut[p + 1] = False
                if p + 1 + len(ending) < n:
                    cut[p + 1 + len(ending)] = True
                break
    at = np.flatnonzero(cut).tolist()
    ends = at[1:]
    ends.append(n)
    return [text[a:b] for a, b in zip(at, ends)]


#: How the byte-level pre-tokenizer cuts a text. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class MergeAutomaton:
    """Tables of the automaton, and walks over them."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        alphabet = byte_alphabet()
        size = max([*vocab.values(), *added.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            self.labels[i] = token.encode()
        #: By state: the token whose arcs lead to the copy, and the merge that made it. State 0 is the start.
        self.owner, self.made = [-1], [0]
        #: By token: the state its arcs led to before the first copy.
        self.base: dict[int, int] = {}
        #: (u, v) as one number: the merge that took the arc v from the copy that u leads to.
        self.lost: dict[int, int] = {}
        #: By token: the left part, the merge that made it, the state its arcs lead to (-1: no arc).
        self.left, self.born, self.to = [-1] * size, [0] * size, [-1] * size
        for c in alphabet:
            self.to[vocab[c]] = 0
        for k, (a, b) in enumerate(merges, 1):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.spelled: dict[bytes, int] = {}
        for token, i in vocab.items():
            if self.to[i] >= 0:
                label = self.labels[i]
                for n in range(1, len(label)):
                    self.spelled.setdefault(label[:n], -1)
                self.spelled[label] = i
        self.added = added
        #: By token: bytes of its label, and the next shorter token that begins it.
        self.size = [len(x) for x in self.labels]
        self.shorter = [-1] * size
        for label, i in self.spelled.items():
            if i >= 0:
                self.shorter[i] = next((t for n in range(len(label) - 1, 0, -1) if (t := self.spelled.get(label[:n], -1)) >= 0), -1)
        #: Arcs read from the tables so far.
        self.arcs: dict[int, bool] = {}

    def _gadget(self, k: int, u: int, v: int, uv: int) -> None:
        old = self.to[u]
        if old < 0 or self.to[v] < 0 or self.to[uv] >= 0 or not self.has_arc(old, v):
            return  # no path has u before v any more, or the token has arcs already
        self.left[uv], self.born[uv] = u, k
        self.to[uv] = self.to[v]
        self.base.setdefault(u, old)
        self.to[u] = len(self.owner)
        self.owner.append(u)
        self.made.append(k)
        self.lost[u << 32 | v] = k

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this token, read from the tables.

        The states it was copied from, back to the start, fall into runs with one owner each. The
        arc is missing if one of them lost the token, or lost the part of it that begins it and
        that stood for it when the copy was made.
        """
        born, left, lost = self.born, self.left, self.lost
        while state:
            owner = self.owner[state]
            made, part, until = self.made[state], token, 1 << 62
            while part >= 0:
                k = lost.get(owner << 32 | part)
                if k is not None and k <= made and k <= until:
                    return False
                part, until = left[part], born[part]
            state = self.base[owner]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the bytes of a pre-split word."""
        n, spelled = len(word), self.spelled
        whole = spelled.get(word, -1)
        if whole >= 0:
            return [whole]
        i, q, state, dead, path, size = 0, 0, [], set(), [], self.size
        token = self._longest(word, 0)
        while i < n:
            while token >= 0:
                if i + size[token] not in dead:
                    arc = self.arcs.get(q << 32 | token)
                    if arc is None:
                        arc = self._read(q, token)
                    if arc:
                        break
                token = self.shorter[token]
            if token >= 0:
                state.append(q)
                path.append(token)
                i, q = i + size[token], self.to[token]
                if i < n:
                    token = self._longest(word, i)
            else:  # the path to a position is unique, so it leads nowhere from here
                dead.add(i)
                token, q = path.pop(), state.pop()
                i -= size[token]
                token = self.shorter[token]
        return path

    def _longest(self, word: bytes, i: int) -> int:
        get, found = self.spelled.get, -1
        for j in range(i + 1, len(word) + 1):
            token = get(word[i:j])
            if token is None:
                break
            if token >= 0:
                found = token
        return found

    def _read(self, q: int, token: int) -> bool:
        if len(self.arcs) >= READ_ARCS:
            self.arcs.clear()
        arc = self.arcs[q << 32 | token] = self.has_arc(q, token)
        return arc


class Encoder:
    """Whole texts to ids and back. One for each worker and vocabulary file."""

    #: The byte-level pattern, for characters below U+1C80: there all versions of Unicode agree.
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^W\p{L}\p{N}]+|[W]+(?![^W])|[W]+".replace("W", r"\x09-\x0D\x20\x85\xA0\u1680"))

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.automaton = MergeAutomaton({k: v for k, v in spec["model"]["vocab"].items() if k not in added}, merges, added)
        self.added_at = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.remembered = remembered
        self.decimal = [str(i) for i in range(len(self.automaton.labels))]

    def _word(self, word: str) -> bytes:
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.words) >= self.remembered // 2:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = packed
        return packed

    def _split(self, text: str) -> bytes:
        get, word = self.words.get, self._word
        return b"".join([get(w) or word(w) for w in split_words(text)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and a chunk behind it; b"" if words don't end before that space."""
        if not chunk or chunk[0].isspace():
            return b""
        get, word = self.words.get, self._word
        packed = b"".join([get(w) or word(w) for w in self.pattern.findall(" " + chunk)]) if max(chunk) < "\u1c80" else self._split(" " + chunk)
        if len(self.chunks) >= self.remembered:
            self.chunks.clear()
        if len(chunk) <= 64:
            self.chunks[chunk] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        """Words end before a space that something else than white space follows, so the parts
        between such spaces are looked up whole."""
        first, *chunks = text.split(" ")
        get, chunk = self.chunks.get, self._chunk
        parts = [get(c) or chunk(c) for c in chunks]
        if not all(parts):
            return self._split(text)
        return b"".join([self._split(first), *parts])

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.added_at is None or not self.added_at.search(text):
            return self._plain(text)
        parts = self.added_at.split(text)
        step = self.added_at.groups + 1
        out = []
        for i, part in enumerate(parts):
            if part:
                out.append(struct.pack("<I", self.automaton.added[part]) if i % step else self._plain(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one behind the other; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.automaton.labels.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class LibraryEncoder:
    """The same ids from the tiktoken library, for operators whose subject isn't encoding.

    It takes a vocabulary whose ids follow the order of the merges; tests hold it against the automaton.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, added = byte_alphabet(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self._encode = tiktoken.Encoding("library", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added).encode

    def packed(self, text: str) -> bytes:
        try:
            return np.array(self._encode(text, allowed_special="all"), "<u4").tobytes()
        except ValueError:  # its pattern gives up on very long runs of white space
            return encoder(self.path).packed(text)


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    decimal, labels = own.decimal.__getitem__, own.automaton.labels.__getitem__
    for batch in batches:
        n, coded, decoded = [], [], []
        for text in batch.column("text"):
            ids = own.encode(text.as_py())
            n.append(len(ids))
            coded.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
            plain = b"".join(map(labels, ids))
            decoded.append(hashlib.sha256(plain.decode("utf-8", "replace").encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        for i, text in enumerate(batch.column("text")):
            ids = pa.array(np.frombuffer(own.packed(text.as_py()), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=["doc_id", "ids"])


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        for i, ids in enumerate(batch.column("ids")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([own.decode(ids.as_py() or [])], pa.string())], names=["doc_id", "text"])


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of each whole text. A null text is empty; repeated rows stay rows."""
    path = path or default_path()
    return texts(docs).mapInArrow(lambda it: _ids(path, it), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of each row of ids. Null ids are no ids: an empty text."""
    path = path or default_path()
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(path, it), "doc_id long, text string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes every whole text and decodes it again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row for each input row, in no order. A null or empty text has no ids, and both digests are
    of the empty string. The added token's string in a text is the added token. No shuffle.
    """
    path = path or default_path()
    return texts(docs).mapInArrow(lambda it: _digests(path, it), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
