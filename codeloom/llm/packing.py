"""Best-fit packing of encoded documents with a linear grouping scheme.

Lengths are whole numbers up to the sequence length, so how many pieces there are of each length
says all that a plan needs: it is at most as many rows as a sequence has tokens. The driver plans
with these counts. Large lengths, sorted, are cut into groups of equal cardinality and rounded up to the
largest of their group; column generation finds the configurations of the few rounded sizes; actual
lengths take the places of the rounded ones; what is left is best-fitted, longest first, into what
room there is. All steps handle runs of equal sequences at once, so the plan is small however many
documents there are. Executors then look up where the n-th piece of a length goes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.bpe import default_path, library_encoder
from codeloom.llm.common import materialize, running_total, shuffle_partitions, texts

CAPACITY = 2048
GROUPS = 40
#: Lengths over this share of a sequence are large.
LARGE = 1 / 3
#: Pieces of one block of the ranks.
BLOCK_ROWS = 50_000


class Segment(NamedTuple):
    """Pieces number rank_from to rank_from + n - 1 of a length lie in sequences first to first + sequences - 1, in turn, from offset on."""

    length: int
    rank_from: int
    n: int
    first: int
    sequences: int
    offset: int


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Multisets of sizes that fit in a sequence, and how often each is used: the linear program of
    fewest sequences, solved by column generation (a knapsack finds each new configuration)."""
    k, size, need = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // size).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount, price = inverse @ need, np.ones(k) @ inverse
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            value = np.where(size <= c, best[c - np.minimum(size, c)] + price, -1.0)
            g = int(value.argmax())
            best[c], took[c] = (value[g], g) if value[g] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[took[c]] += 1
                c -= int(size[took[c]])
        step = inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return [(basis[:, p].astype(int).tolist(), max(0.0, x)) for p, x in enumerate(np.linalg.inv(basis) @ need)]


class Plan:
    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.segments, self.sequences = capacity, [], 0
        self.left = {n: c for n, c in counts.items() if c}
        self.rank = dict.fromkeys(self.left, 0)
        #: By room left: runs of sequences (first, how many).
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        if capacity in self.left:
            self._put(capacity, self.left[capacity], self._open(self.left[capacity]), self.left[capacity], 0)
        self._large(groups)
        self._rest()

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, length: int, n: int, first: int, sequences: int, offset: int) -> None:
        self.segments.append(Segment(length, self.rank[length], n, first, sequences, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _large(self, groups: int) -> None:
        lengths = [n for n in sorted(self.left, reverse=True) if n > self.capacity * LARGE]
        total = sum(self.left[n] for n in lengths)
        if not total:
            return
        each = -(-total // groups)
        queues: list[list[list[int]]] = [[]]
        room = each
        for n in lengths:
            count = self.left[n]
            while count:
                if not room:
                    queues.append([])
                    room = each
                take = min(count, room)
                queues[-1].append([n, take])
                count -= take
                room -= take
        sizes: dict[int, list[list[int]]] = {}
        for q in queues:  # groups that round to the same size are one
            sizes.setdefault(q[0][0], []).extend(q)
        rounded = list(sizes)
        for pattern, amount in configurations(rounded, [sum(c for _, c in sizes[s]) for s in rounded], self.capacity):
            if times := int(amount + 1e-6):
                self._substitute([sizes[rounded[g]] for g, n in enumerate(pattern) for _ in range(n)], times)

    def _substitute(self, columns: list[list[list[int]]], times: int) -> None:
        """Actual lengths for the places of a configuration: each place takes the next ones of its group."""
        taken: list[list[list[int]]] = []
        for queue in columns:
            runs, want = [], times
            while want and queue:
                take = min(want, queue[0][1])
                runs.append([queue[0][0], take])
                want -= take
                queue[0][1] -= take
                if not queue[0][1]:
                    queue.pop(0)
            if want:
                runs.append([0, want])
            taken.append(runs)
        while taken[0]:
            n = min(runs[0][1] for runs in taken)
            here = [runs[0][0] for runs in taken if runs[0][0]]
            for runs in taken:
                runs[0][1] -= n
                if not runs[0][1]:
                    runs.pop(0)
            if here:
                first, offset = self._open(n), 0
                for length in here:
                    self._put(length, n, first, n, offset)
                    offset += length
                self.free[self.capacity - offset].append((first, n))

    def _rest(self) -> None:
        for length in sorted(self.left, reverse=True):
            room = length
            while count := self.left.get(length, 0):
                while room <= self.capacity and not self.free[room]:
                    room += 1
                if room > self.capacity:
                    room = length
                    n = -(-count // (self.capacity // length))
                    self.free[self.capacity].append((self._open(n), n))
                    continue
                first, n = self.free[room].pop()
                fit = room // length
                full = min(n, count // fit)
                if full:
                    self._put(length, fit * full, first, full, self.capacity - room)
                    self.free[room - fit * length].append((first, full))
                if full < n and (few := min(self.left.get(length, 0), fit - 1)):
                    self._put(length, few, first + full, 1, self.capacity - room)
                    self.free[room - few * length].append((first + full, 1))
                    full += 1
                if full < n:
                    self.free[room].append((first + full, n - full))


def _pieces(path: str, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = library_encoder(path)
    for batch in batches:
        rows: list[list] = [[] for _ in range(5)]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = own.packed(text.as_py()) + b"\0\0\0\0"
            n = len(ids) // 4
            start, end = 0, (n % capacity or capacity)
            piece = 0
            while start < n:
                for column, value in zip(rows, (doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end]))):
                    column.append(value)
                start, end, piece = end, end + capacity, piece + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Packs all documents into as few sequences of at most capacity tokens as the plan finds.

    A document is its ids and id 0. Null and empty texts are the id 0 alone. Only documents longer
    than a sequence are cut; their first piece may be shorter. Repeated rows and rows without a doc_id are packed as often as
    they occur; an empty table gives no rows. Returns for each piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces (some 40 bytes each) are written once, as both the counts and the ranks need them.
    """
    path = path or default_path()
    pieces = texts(docs).mapInArrow(lambda it: _pieces(path, capacity, it), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = Plan(counts, capacity, groups)
    spark = docs.sparkSession
    segments = spark.createDataFrame([tuple(s) for s in plan.segments], "at long, rank_from long, n long, first long, sequences long, from_offset long")
    blocks = max(shuffle_partitions(spark), sum(counts.values()) // BLOCK_ROWS)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    before = running_total(pieces.groupBy("length", "block").agg(F.count("*").alias("in_block")), ["length"], "block", "in_block", "before").drop("in_block")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("row")) - 1)
    ranked = ranked.join(before, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the plan has a few rows for each length, and lengths are bounded by the capacity
    placed = ranked.join(F.broadcast(segments), (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("n")))
    turn = F.col("rank") - F.col("rank_from")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + turn % F.col("sequences")).alias("sequence_id"), (F.col("from_offset") + F.expr("((rank - rank_from) div sequences) * length")).alias("offset"))
