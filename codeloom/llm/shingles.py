"""Word shingles and their MinHash signatures, in numpy over whole texts.

Text is lower-cased in A-Z; words are runs of bytes other than space and 0x09-0x0D. A document's set
holds the distinct shingles of five words; a shorter text is one shingle; no words, no shingles.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

WIDTH = 5
PERMUTATIONS = 128
SEED = 20240607
#: About the bytes of a text whose words are hashed at a time.
SLICE = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


@functools.cache
def _constants() -> dict:
    rng = np.random.default_rng(SEED)
    odd = int(rng.integers(1 << 63, dtype=np.uint64)) | 1
    return {"byte": rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), "base": odd, "inverse": pow(odd, -1, 1 << 64), "word": int(rng.integers(1 << 63, dtype=np.uint64)) | 1}


_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    """The first n powers of a constant modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        column = np.full(max(n, 1 << 16), _constants()[name], np.uint64)
        column[0] = 1
        have = np.multiply.accumulate(column)
        if n <= 1 << 22:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words in their order. Long texts are taken slice by slice, so what is needed beside
    the text and the hashes doesn't grow with it (unless a single word is longer than a slice)."""
    data, parts, at = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8), [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and not (ends := WHITE[data[end : end + 4096]]).any():
            end += 4096
        if end < len(data):
            end += int(ends.argmax())
        parts.append(_hashed(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _hashed(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~WHITE[data]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_constants()["byte"][data] * _power("base", len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _power("inverse", len(data))[start] + (end - start).astype(np.uint64))


def count_words(text: str) -> int:
    inside = ~WHITE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].sum())


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the shingles, in the order of the text."""
    words = word_hashes(text)
    n = min(width, len(words))
    if not n:
        return words
    c, total = _constants()["word"], np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total *= np.uint64(c)
        total += words[i : len(words) - n + 1 + i]
    return mix(total + np.uint64(n))


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    return np.unique(shingles(text, width))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set, as two signed integers."""
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), "<i8").tolist())


@functools.cache
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    return rng.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1 << 63, size=n, dtype=np.uint64)


def signature(shingles: np.ndarray, n: int = PERMUTATIONS, start: np.ndarray | None = None) -> np.ndarray:
    """Minima under n universal hash functions a * x + b; 0 for an empty set. start: minima of a set that is added."""
    if not len(shingles):
        return np.zeros(n, np.uint64) if start is None else start.copy()
    a, b = permutations(n)
    step = max(1, (1 << 16) // n)
    buffer = np.empty((n, step), np.uint64)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64) if start is None else start.copy()
    for i in range(0, len(shingles), step):
        part = shingles[i : i + step]
        here = buffer[:, : len(part)]
        np.multiply(a[:, None], part[None, :], out=here)
        here += b[:, None]
        np.minimum(out, here.min(axis=1), out=out)
    return out


def marks(values: np.ndarray) -> np.ndarray:
    """16 bits of each minimum. Minima of large sets are all small, so their bits are spread first; 0 for an empty set."""
    return (mix(values) & np.uint64(0xFFFF)).astype("<u2")


def bands(table: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit hash for each band of so many marks, by row of marks; equal marks in different bands differ."""
    n = table.shape[1] // rows
    grouped = table[:, : n * rows].reshape(len(table), n, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), (len(table), n)).copy()
    for i in range(rows):
        total = mix(total * np.uint64(_constants()["word"]) + grouped[:, :, i])
    return total.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
