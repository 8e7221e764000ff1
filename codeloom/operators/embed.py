"""Embedders and the join of units, cache and embedder.

HashingEmbedder needs no service: tasks count words in Arrow batches. A RemoteEmbedder calls a client batch by batch and
has a ladder for failures: a chunk that is refused is sent again as plain ASCII, then text by text, then
with letters and numbers only; what still fails is a row with a status and no vector, and isn't cached. A task has a bounded
number of chunks in flight, waits before it tries again, and gives results in the order of the chunks.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.functions import text as T
from codeloom.functions import vectors as V
from codeloom.operators import batching, cache

OK = "ok"


class Embedder(Protocol):
    model: str
    dimensions: int

    def embed(self, contents: DataFrame) -> DataFrame:
        """content_hash, vector, status of rows content_hash, content."""

    def embed_query(self, query: str) -> list[float]: ...


_WORD = re.compile(rb"[a-z0-9]+")


class Places(dict):
    """Of each word the place in a vector: the first seven hexadecimal digits of its MD5, modulo the dimensions. Words that come again
    are looked up; so many are held."""

    MOST = 200_000

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = place = int(hashlib.md5(word).hexdigest()[:7], 16) % self.dimensions
        return place


def counted(text: bytes, places: Places) -> list[float]:
    """How many words of a text in lower case have each place, scaled to length 1."""
    counts = [0] * places.dimensions
    for word, n in Counter(_WORD.findall(text)).items():
        counts[places[word]] += n
    length = math.sqrt(sum(n * n for n in counts))
    return [n / length for n in counts] if length else [0.0] * places.dimensions


class HashingEmbedder:
    """Term counts in buckets by the words' MD5, scaled to length 1. A text without words is zeros."""

    def __init__(self, dimensions: int = 64):
        self.model, self.dimensions = f"hashing-{dimensions}", dimensions

    def vectors(self, rows: DataFrame, key: str, text: Column) -> DataFrame:
        """key, vector of rows with a unique key. Words are counted where their text is: nothing is shuffled."""
        dimensions = self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = Places(dimensions)
            for batch in batches:
                vectors = np.array([counted(text.as_py() or b"", places) for text in batch.column(1)], np.float64).astype(np.float32).reshape(-1)
                ends = pa.array(np.arange(0, len(vectors) + 1, dimensions, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(vectors))], names=[key, "vector"])

        return rows.select(key, F.lower(text).cast("binary").alias("text")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<float>")

    def embed(self, contents: DataFrame) -> DataFrame:
        return self.vectors(contents, "content_hash", T.prepare("content")).withColumn("status", F.lit(OK))

    def embed_query(self, query: str) -> list[float]:
        return counted(query.lower().encode(), Places(self.dimensions))


Client = Callable[[Sequence[str]], list[list[float]]]
Answer = tuple[list[float] | None, str]


class Busy(Exception):
    """What a client raises if it can't answer now; after: the seconds that it asks to wait, if it says."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


class Calls(NamedTuple):
    """How a task calls its client: chunks at a time, turns after the first for calls that failed without being refused, seconds
    before the first of these (twice as many before each next one), and the longest wait."""

    in_flight: int = 4
    retries: int = 4
    wait: float = 0.1
    longest: float = 30.0


def plain(text: str) -> str:
    """As sanitize_aggressive, for one text."""
    out = re.sub(r"""[\\"'\x00-\x1f\x7f-\x9f]""", " ", re.sub(r"\s+", " ", re.sub(r"[^\x00-\x7F]", " ", text)))
    return out if out.strip() else T.EMPTY


def plainest(text: str) -> str:
    out = " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in text).split())
    return out or T.PLACEHOLDER


#: Steps of the ladder for one text.
STEPS: tuple[tuple[str, Callable[[str], str]], ...] = ((OK, str), ("plain", plain), ("plainest", plainest))


class Ladder:
    """The calls for one chunk. asked counts them, without what was only tried again."""

    def __init__(self, client: Client, calls: Calls):
        self.client, self.calls, self.asked = client, calls, 0

    def _ask(self, texts: list[str]) -> list[list[float]]:
        """A client raises ValueError for input that it refuses; other errors are tried again, then raised."""
        self.asked += 1
        for turn in range(self.calls.retries + 1):
            try:
                found = self.client(texts)
                break
            except ValueError:
                raise
            except Exception as why:
                if turn == self.calls.retries:
                    raise
                asked = why.after if isinstance(why, Busy) else None
                time.sleep(min(self.calls.longest, self.calls.wait * 2**turn if asked is None else asked))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found

    def one(self, text: str) -> Answer:
        for status, change in STEPS:
            try:
                return self._ask([change(text)])[0], status
            except ValueError as refused:
                last = f"failed: {refused}"
        return None, last

    def chunk(self, texts: list[str]) -> list[Answer]:
        """Vectors and statuses; only what every step of the ladder refuses has no vector. A chunk that is too long goes text by
        text at once, any other refused one goes as plain ASCII before."""
        try:
            return [(v, OK) for v in self._ask(texts)]
        except ValueError as refused:
            if "max_tokens" not in str(refused):
                try:
                    return [(v, "plain") for v in self._ask([plain(t) for t in texts])]
                except ValueError:
                    pass
        return [self.one(text) for text in texts]


def called(client: Client, texts: list[str], calls: Calls = Calls()) -> list[Answer]:
    return Ladder(client, calls).chunk(texts)


def in_order(work: Callable, jobs: Iterable, most: int) -> Iterator:
    """work(job) for each job, in their order, by threads; as many jobs as may run at a time are begun, done or waiting to be
    taken, so what is held doesn't grow with their number."""
    with ThreadPoolExecutor(most) as pool:
        begun: deque = deque()
        try:
            for job in jobs:
                begun.append(pool.submit(work, job))
                if len(begun) == most:
                    yield begun.popleft().result()
            while begun:
                yield begun.popleft().result()
        finally:
            for future in begun:
                future.cancel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one batch and chunk, which follow each other."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["batch"], row["chunk"]) != (rows[0]["batch"], rows[0]["chunk"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


ANSWERS = "batch long, chunk long, vector array<float>, status string, asked int"


class RemoteEmbedder:
    """Calls a client that each task makes for itself, on chunks that the batch plan cuts; several chunks are in flight at a
    time, so a client must bear calls from several threads."""

    def __init__(self, make_client: Callable[[], Client], model: str, dimensions: int, calls: Calls = Calls()):
        self.make_client, self.model, self.dimensions, self.calls = make_client, model, dimensions, calls

    def answers(self, rows: DataFrame, key: str, text: Column, order: str | None = None) -> DataFrame:
        """key, batch, chunk, vector (null if all was refused), status, asked (calls for the chunk) of each row's text, in
        chunks by the order of a column (the key)."""
        prepared = rows.select(key, *([order] if order and order != key else []), text.alias("text")).withColumn("tokens", T.token_estimate("text"))
        planned = batching.plan(prepared, order or key, "tokens").select(key, "text", "batch", "chunk", "pos", "single")
        make, width, calls = self.make_client, self.dimensions, self.calls
        kind = to_arrow_type(planned.schema[key].dataType)

        def answered(client: Client, own: list[dict]) -> pa.RecordBatch:
            ladder, texts = Ladder(client, calls), [r["text"] for r in own]
            found = [ladder.one(t) for t in texts] if own[0]["single"] else ladder.chunk(texts)
            vectors = [None if v is None else [float(x) for x in (list(v) + [0.0] * width)[:width]] for v, _ in found]
            columns = [pa.array([r[key] for r in own], kind), *(pa.array([r[c] for r in own], pa.int64()) for c in ("batch", "chunk")), pa.array(vectors, pa.list_(pa.float32())), pa.array([s for _, s in found], pa.string()), pa.array([ladder.asked] * len(own), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=[key, *(x.split()[0] for x in ANSWERS.split(", "))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = make()
            yield from in_order(lambda own: answered(client, own), _chunks(batches), calls.in_flight)

        dealt = planned.repartition("batch").sortWithinPartitions("batch", "pos")
        return dealt.mapInArrow(run, f"{key} {planned.schema[key].dataType.simpleString()}, {ANSWERS}")

    def embed(self, contents: DataFrame) -> DataFrame:
        return self.answers(contents, "content_hash", T.prepare("content")).select("content_hash", "vector", "status")

    def embed_query(self, query: str) -> list[float]:
        found = called(self.make_client(), [query[: T.TEXT_CUT] or T.PLACEHOLDER], self.calls)[0][0]
        if found is None:
            raise ValueError("the query can't be embedded")
        return (found + [0.0] * self.dimensions)[: self.dimensions]


def embed_units(units: DataFrame, embedder: Embedder, cached: DataFrame) -> DataFrame:
    """content_hash, model, dimensions, vector, status of contents that the cache lacks; each once."""
    own = cached.where((F.col("model") == embedder.model) & (F.col("dimensions") == embedder.dimensions))
    new = embedder.embed(cache.misses(units, own))
    return new.select("content_hash", F.lit(embedder.model).alias("model"), F.lit(embedder.dimensions).alias("dimensions"), V.resize("vector", embedder.dimensions).alias("vector"), "status")
