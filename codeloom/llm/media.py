"""Media columns: signatures find, validators confirm, embedded media are carved.

An Aho-Corasick automaton over the magic bytes of all formats finds, in one pass, where a medium may begin.
A validator for the format then walks its structure (chunks, blocks, segments, check sums) and gives
its length, or nothing if it isn't one. The type declared for a value is corrected to what its first bytes
prove to be; media inside other media are listed with their places.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import texts

UNKNOWN = "application/octet-stream"
ALIGN = 64
TAIL = 64


class Medium(NamedTuple):
    kind: str
    start: int
    length: int


#: Bytes between two stored sums.
SUMS = 8192


@functools.cache
def _zero_operators() -> list[list[int]]:
    """What 1, 2, 4, ... bytes 0 behind some bytes make of their CRC-32: a matrix over bits, by columns."""
    square = lambda m: [_times(m, x) for x in m]
    out = [square(square(square([0xEDB88320, *(1 << i for i in range(31))])))]
    while len(out) < 48:
        out.append(square(out[-1]))
    return out


def _times(matrix: list[int], bits: int) -> int:
    total = 0
    for column in matrix:
        if bits & 1:
            total ^= column
        bits >>= 1
    return total


def _with_zeros(crc: int, n: int) -> int:
    for matrix in _zero_operators():
        if n & 1:
            crc = _times(matrix, crc)
        n >>= 1
    return crc


class Chains:
    """Where walks over the parts of one format's media have led, by part: to an end, or nowhere. A walk that comes to a
    part which an earlier one has passed goes no further, so all walks together pass each part once.

    Media are sought from left to right, each within the medium around it, so what didn't end there ends nowhere.
    """

    def __init__(self, places: int):
        self.walk = np.zeros(places, np.uint32)  # untouched pages take no memory
        self.ends: list[int | None] = [None, None]

    def end(self, part: int, step: Callable[[int], tuple[int | None, int | None]]) -> int | None:
        """step(part): the next part and None, or None and where the medium ends (None: nowhere)."""
        passed, at = [], part
        while True:
            if at >= len(self.walk):
                end = None
                break
            if known := int(self.walk[at]):
                end = self.ends[known]
                break
            passed.append(at)
            at, end = step(at)
            if at is None:
                break
        number = 1
        if end is not None:
            number = len(self.ends)
            self.ends.append(end)
        self.walk[passed] = number
        return end


class Riff:
    """Chains of RIFF chunks. How far a file's chain goes is told by its head, so chains are kept as lists of places; one that
    comes to a place of another goes on there."""

    def __init__(self, data: bytes):
        self.data = data
        self.at: dict[int, tuple[int, int]] = {}  # the chain that a place belongs to, and its number there
        self.chains: list[tuple[list[int], list[int], list[int]]] = []  # places; format and data chunks before each

    def whole(self, place: int, end: int) -> bool:
        """Whether the chunks from a place on end where they should, with a format and samples among them."""
        formats = samples = 0
        while True:
            if place not in self.at:
                self.at[place] = len(self.chains), 0
                self.chains.append(([place], [0], [0]))
            number, first = self.at[place]
            places, fmt, data = self.chains[number]
            while (last := places[-1]) + 8 <= end and self.at[last] == (number, len(places) - 1):
                name, size = self.data[last : last + 4], int.from_bytes(self.data[last + 4 : last + 8], "little")
                fmt.append(fmt[-1] + (name == b"fmt "))
                data.append(data[-1] + (name == b"data"))
                places.append(last + 8 + size + size % 2)
                self.at.setdefault(places[-1], (number, len(places) - 1))
            k = bisect.bisect_left(places, end - 7, first)
            i = min(k, len(places) - 1)
            formats, samples = formats + fmt[i] - fmt[first], samples + data[i] - data[first]
            if k < len(places):
                return places[k] in (end, end + 1) and formats > 0 and samples > 0
            place = places[-1]


class Places:
    """Where marks lie in a value, each kind found in one pass when it is first asked for, so that no validator
    reads on to the end of the value for every head."""

    def __init__(self, data: bytes):
        self.data = data
        self._of: dict[bytes, list[int]] = {}
        self._chains: dict[str, Chains] = {}
        self.inflated: dict[int, int | None] = {}

    def of(self, mark: bytes) -> list[int]:
        if mark not in self._of:
            self._of[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self._of[mark]

    def first(self, mark: bytes, start: int, end: int) -> int:
        """The first whole mark between two places, -1 if there is none."""
        places = self.of(mark)
        i = bisect.bisect_left(places, start)
        return places[i] if i < len(places) and places[i] + len(mark) <= end else -1

    @functools.cached_property
    def trailers(self) -> np.ndarray:
        """Start, end and number of each trailer of a PDF."""
        return np.array([(m.start(), m.end(), min(int(m[1]), 1 << 62)) for m in _TRAILER.finditer(self.data)], np.int64).reshape(-1, 3)

    @functools.cached_property
    def by_number(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the trailers in order, and which trailers have them."""
        order = np.argsort(self.trailers[:, 2], kind="stable")
        return self.trailers[order, 2], order

    @functools.cached_property
    def stops(self) -> np.ndarray:
        """Where a JPEG's scan may end: markers other than stuffed bytes and restarts."""
        return np.array([m.start() for m in _STOP.finditer(self.data)], np.int64)

    def chains(self, kind: str, states: int = 1) -> Chains:
        if kind not in self._chains:
            self._chains[kind] = Chains(states * (len(self.data) + 1))
        return self._chains[kind]

    @functools.cached_property
    def riff(self) -> Riff:
        return Riff(self.data)

    @functools.cached_property
    def sums(self) -> list[int]:
        """CRC-32 of the bytes before each multiple of SUMS."""
        out, view = [0], memoryview(self.data)
        for at in range(0, len(view), SUMS):
            out.append(zlib.crc32(view[at : at + SUMS], out[-1]))
        return out

    def crc32(self, start: int, end: int) -> int:
        """Of the bytes between two places; long ranges by the sums of what lies before their ends."""
        view = memoryview(self.data)
        if end - start <= 2 * SUMS:
            return zlib.crc32(view[start:end])
        before, whole = (zlib.crc32(view[x - x % SUMS : x], self.sums[x // SUMS]) for x in (start, end))
        return whole ^ _with_zeros(before, end - start)

    @functools.cached_property
    def archives(self) -> dict[int, list[tuple[int, int, int]]]:
        """By the start that an end record of a zip file implies: its directory's place and size, and where it ends."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for place in self.of(b"PK\x05\x06"):
            if place + 22 <= len(self.data):
                size, offset, note = struct.unpack_from("<IIH", self.data, place + 12)
                out.setdefault(place - size - offset, []).append((place - size, size, place + 22 + note))
        return out


def _wav(data: memoryview, at: int, places: Places) -> int | None:
    if len(data) < at + 12 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    return end - at if end <= len(data) and at + 12 <= end and places.riff.whole(at + 12, end) else None


def _png(data: memoryview, at: int, places: Places) -> int | None:
    def step(place: int) -> tuple[int | None, int | None]:
        if place + 12 > len(data):
            return None, None
        size, name = int.from_bytes(data[place : place + 4]), bytes(data[place + 4 : place + 8])
        end = place + 12 + size
        if end > len(data) or name == b"IHDR" or places.crc32(place + 4, end - 4) != int.from_bytes(data[end - 4 : end]):
            return None, None
        return (None, end) if name == b"IEND" else (end, None)

    head = data[at + 8 : at + 33]  # always of 13 bytes
    if len(head) < 25 or head[:8] != b"\0\0\0\x0dIHDR" or zlib.crc32(head[4:21]) != int.from_bytes(head[21:]):
        return None
    end = places.chains("png").end(at + 33, step)
    return end - at if end is not None and end <= len(data) else None


def _gif(data: memoryview, at: int, places: Places) -> int | None:
    def step(part: int) -> tuple[int | None, int | None]:
        place, inside = divmod(part, 2)  # a block, or one of the pieces of its data
        try:
            if inside:
                return 2 * (place + data[place] + 1) + (data[place] > 0), None
            if data[place] == 0x3B:
                return None, place + 1
            if data[place] == 0x2C:
                return 2 * (place + 10 + (3 << (data[place + 9] & 7) + 1 if data[place + 9] & 0x80 else 0) + 1) + 1, None
            return (2 * (place + 2) + 1, None) if data[place] == 0x21 else (None, None)
        except IndexError:
            return None, None

    if at + 13 > len(data):
        return None
    end = places.chains("gif", 2).end(2 * (at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0)), step)
    return end - at if end is not None and end <= len(data) else None


#: Ends of a scan: bytes 0 are stuffed behind 0xFF, and D0 to D7 are restarts.
_STOP = re.compile(rb"\xff(?=[^\x00\xd0-\xd7])", re.DOTALL)


def _jpeg(data: memoryview, at: int, places: Places) -> int | None:
    def step(part: int) -> tuple[int | None, int | None]:
        place, scanned = divmod(part, 2)
        if place + 2 > len(data) or data[place] != 0xFF:
            return None, None
        mark = data[place + 1]
        if mark == 0xD9:
            return None, place + 2 if scanned else None
        size = int.from_bytes(data[place + 2 : place + 4])
        if place + 4 > len(data) or size < 2:
            return None, None
        place += 2 + size
        if mark == 0xDA:
            i = int(np.searchsorted(places.stops, place))
            return (2 * int(places.stops[i]) + 1, None) if i < len(places.stops) else (None, None)
        return 2 * place + scanned, None

    end = places.chains("jpeg", 2).end(2 * (at + 2), step)
    return end - at if end is not None and end <= len(data) else None


_TRAILER = re.compile(rb"startxref\s+(\d{1,20})\s+%%EOF")
_XREF = re.compile(rb"xref|\d+\s+\d+\s+obj")


def _pdf(data: memoryview, at: int, places: Places) -> int | None:
    """Up to the last trailer before the next header. Beyond a header (of a file inside or behind this one) a trailer
    counts if it points to a table of this file that was added after its first end."""
    first = places.first(b"%%EOF", at, len(data))
    if first < 0 or places.first(b"startxref", at, first) < 0:
        return None
    first = end = first + 5
    header = places.first(b"%PDF-", first, len(data))
    start, stop, number = places.trailers.T
    low, high = np.searchsorted(start, first), np.searchsorted(stop, min(header, len(data)) if header >= 0 else len(data), "right")
    if high > low:
        end = int(stop[high - 1])
    if header >= 0:
        numbers, order = places.by_number
        far = np.sort(order[np.searchsorted(numbers, first - at) :])
        far = far[(start[far] >= first) & (stop[far] <= len(data)) & (stop[far] > header) & (number[far] < start[far] - at)]
        for i in far[::-1].tolist():
            if _XREF.match(data, at + int(number[i])):
                return int(stop[i]) - at
    return end - at


def _zip(data: memoryview, at: int, places: Places) -> int | None:
    for directory, size, end in places.archives.get(at, ()):
        if directory >= at and end <= len(data) and (not size or data[directory : directory + 4] == b"PK\x01\x02"):
            return end - at
    return None


def _inflated(data: memoryview, start: int) -> int | None:
    """Where a gzip member ends whose compressed data begin here."""
    unpack, place, crc, n = zlib.decompressobj(-15), start, 0, 0
    try:
        while not unpack.eof:
            if place >= len(data):
                return None
            out = unpack.decompress(data[place : place + 65536])
            crc, n, place = zlib.crc32(out, crc), n + len(out), place + 65536
    except zlib.error:
        return None
    end = min(place, len(data)) - len(unpack.unused_data) + 8
    return end if end <= len(data) and bytes(data[end - 8 : end]) == struct.pack("<II", crc, n & 0xFFFFFFFF) else None


def _member(data: memoryview, at: int, places: Places) -> int | None:
    """Where a gzip member ends. Heads whose names end at one byte 0 share what follows it."""
    flags, start = data[at + 3] if at + 10 <= len(data) else 0xFF, at + 10
    if flags & 0xE0:
        return None
    if flags & 4:
        start += 2 + int.from_bytes(data[start : start + 2], "little")
    for text in (8, 16):
        if flags & text:
            start = places.first(b"\0", start, len(data)) + 1
            if not start:
                return None
    start += 2 * bool(flags & 2)
    if start not in places.inflated:
        places.inflated[start] = _inflated(data, start)
    end = places.inflated[start]
    return end if end is not None and end <= len(data) else None


def _members(data: memoryview, at: int, places: Places) -> list[int]:
    """Ends of the whole gzip members that follow each other from here."""
    ends = []
    while data[at : at + 3] == b"\x1f\x8b\x08" and (end := _member(data, at, places)):
        ends.append(end)
        at = end
    return ends


def _gzip(data: memoryview, at: int, places: Places) -> int | None:
    ends = _members(data, at, places)
    return ends[-1] - at if ends else None


def _ogg(data: memoryview, at: int, places: Places) -> int | None:
    def step(place: int) -> tuple[int | None, int | None]:
        if data[place : place + 4] != b"OggS" or place + 27 > len(data):
            return None, None
        table = data[place + 27 : place + 27 + data[place + 26]]
        end = place + 27 + len(table) + sum(table)
        if end > len(data):
            return None, None
        return (None, end) if data[place + 5] & 4 else (end, None)

    end = places.chains("ogg").end(at, step)
    return end - at if end is not None and end <= len(data) else None


#: Kind, magic bytes, how far into the medium they lie, validator.
FORMATS: tuple[tuple[str, bytes, int, Callable[[memoryview, int, Places], int | None]], ...] = (
    ("audio/wav", b"RIFF", 0, _wav),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("audio/ogg", b"OggS", 0, _ogg),
)


@functools.cache
def _automaton():
    import ahocorasick

    own = ahocorasick.Automaton()
    for i, (_, magic, _, _) in enumerate(FORMATS):
        own.add_word(magic.decode("latin-1"), (i, len(magic)))
    own.make_automaton()
    return own


def sniff(data: bytes) -> list[Medium]:
    """Confirmed media by start, the longer first: those inside others too, each once. A medium that
    overlaps the end of another is left out."""
    view, places, found, ends, members = memoryview(data), Places(data), [], [], set()
    for last, (i, n) in _automaton().iter(data.decode("latin-1")):
        kind, _, ahead, validate = FORMATS[i]
        at = last - n + 1 - ahead
        while ends and ends[-1] <= at:
            ends.pop()
        length = validate(view[: ends[-1]] if ends else view, at, places) if at >= 0 and at not in members else None
        if length and not (ends and at + length > ends[-1]) and (not found or found[-1].start != at):
            found.append(Medium(kind, at, length))
            ends.append(at + length)
            if kind == "application/gzip":  # its further members are no media inside it
                members.update(_members(view[: at + length], at, places))
    return found


def corrected(declared: str | None, media: list[Medium]) -> str:
    """The type of the medium that begins the value; else what was declared, unless that names a
    format that would have been recognised."""
    if media and media[0].start == 0:
        return media[0].kind
    return declared if declared and declared not in {f[0] for f in FORMATS} else UNKNOWN


def as_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The bytes as unsigned 8-bit samples of one channel."""
    if len(payload) > 0xFFFFFFFF - 64:
        raise ValueError("a RIFF file holds less than 4 GiB")
    odd = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * odd


def wav_samples(data: bytes, at: int = 0) -> bytes:
    place = at + 12
    while data[place : place + 4] != b"data":
        size = int.from_bytes(data[place + 4 : place + 8], "little")
        place += 8 + size + size % 2
    return data[place + 8 : place + 8 + int.from_bytes(data[place + 4 : place + 8], "little")]


def payload_of(text: str) -> tuple[int, bytes]:
    """Bytes of the text in UTF-8, and these with bytes 0 up to a positive multiple of ALIGN."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (-len(data) % ALIGN if data else ALIGN)


def features(samples: bytes) -> str:
    """Mean, root mean square and crossings of the middle of the samples, as whole numbers."""
    wave = np.frombuffer(samples, np.uint8)
    total, squares = int(wave.sum(dtype=np.int64)), int(np.square(wave.astype(np.uint32)).sum(dtype=np.int64))
    high = wave >= 128
    return f"mean={1000 * total // max(1, len(wave))};ms={squares // max(1, len(wave))};crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TYPES = {"long": pa.int64(), "string": pa.string()}


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for text in batch.column("text"):
            n, payload = payload_of(text.as_py())
            stored = as_wav(payload)
            media = sniff(stored)
            kind = corrected("text/plain", media)
            back = wav_samples(stored, media[0].start)
            inside = ",".join(f"{m.kind}:{m.start}:{m.length}" for m in media[1:])
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{kind};samples={len(back)};{features(back)};inside={inside}")
            for column, value in zip(columns, row):
                column.append(value)
        kinds = [x.split()[1] for x in OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds[1:]))], names=[x.split()[0] for x in OUT.split(", ")])


def text_media(docs: DataFrame) -> DataFrame:
    """Stores each whole text as samples, sniffs what was stored, whose type is declared as the text's, and reads it back.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (read back), media_bytes,
    media_sha256, feature. Null and empty texts are ALIGN bytes 0. One row for each input row.
    """
    return texts(docs).mapInArrow(_stored, OUT)


def _sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        kinds, media = [], []
        for declared, data in zip(batch.column("declared").to_pylist(), batch.column("media")):
            data = data.as_py()
            found = sniff(data) if data is not None else None
            kinds.append(None if found is None else corrected(declared, found))
            media.append(None if found is None else [m._asdict() for m in found])
        out = batch.select([c for c in batch.schema.names if c not in ("kind", "found")])
        yield out.append_column("kind", pa.array(kinds, pa.string())).append_column("found", pa.array(media, part))


def sniff_column(values: DataFrame) -> DataFrame:
    """values (media binary, declared string, other columns) plus kind, the corrected type, and found,
    the confirmed media with their places. A null value has neither; columns of those names are replaced."""
    values = values.drop("kind", "found")
    new = T.StructType.fromDDL("kind string, found array<struct<kind:string,start:bigint,length:bigint>>")
    schema = T.StructType([*values.schema.fields, *new.fields])
    return values.mapInArrow(_sniffed, schema)


def carve(sniffed: DataFrame) -> DataFrame:
    """One row for each confirmed medium that doesn't stand for its whole value: number, kind, bytes."""
    keep = [c for c in sniffed.columns if c not in ("found", "kind", "number")]
    rows = sniffed.select(*keep, F.posexplode("found").alias("number", "part"))
    whole = (F.col("part.start") == 0) & (F.col("part.length") == F.length("media"))
    return rows.where(~whole).select(*[c for c in keep if c != "media"], "number", F.col("part.kind").alias("kind"), F.expr("substring(media, cast(part.start + 1 as int), cast(part.length as int))").alias("carved"))
