"""Best-fit packing of whole documents by large-item matching.

No more than two pieces above a third of the capacity fit into one sequence. They are matched first: from the longest
down, each piece above a half takes the longest partner that fits, and what is then left between a third and a half pairs
up from the longest down. This greedy matching makes as many pairs as any can: partners of a longer piece are partners of
every shorter one. Smaller pieces follow from the longest down, each into the fullest sequence that has room for it, and
a new sequence opens only where none has.

Lengths are whole numbers up to the capacity, so pieces of one length are interchangeable, and the packing needs their
counts only. The histogram, at most `capacity` rows whatever the input, comes to the driver; `Plan` turns it into runs,
each saying where so many pieces of one length go. Every piece then finds its own place from its rank among the pieces of
its length. Ranks are sums of the counts of the tasks before it: nothing is sorted, and no task sees the pieces of another.

Documents above the capacity give full pieces and, before them, one shorter piece with the rest. null and empty texts are
documents of one token, the end token; rows with a null doc_id are packed like others; repeated rows are packed as often as
they occur. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfloom.llm.packing import CAPACITY, tokens
from perfloom.llm.tables import bounded, checkpoints, slices, small_batches, stored

END = 0


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be below the capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


class Plan:
    """Where the pieces of each length go. `runs[length]` holds (first rank, pieces, first sequence, pieces a sequence, offset).

    Piece i of a run goes to sequence `first + i // k` at `offset + i % k * length`, with k pieces of it a sequence.
    There are at most some runs for each pair of lengths that meet, independent of how many pieces there are.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.used = [0] * (capacity + 1)
        self.runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
        #: gap: (first sequence, sequences) of those with this gap
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self._large()
        for length in range(capacity // 3, 0, -1):
            self._small(length)

    def _put(self, length: int, n: int, first: int, k: int, offset: int) -> None:
        self.runs.setdefault(length, []).append((self.used[length], n, first, k, offset))
        self.used[length] += n
        self.left[length] -= n

    def _opened(self, n: int, gap: int) -> int:
        first = self.sequences
        self.sequences += n
        self.gaps[gap].append((first, n))
        return first

    def _pair(self, a: int, b: int, n: int) -> None:
        first = self._opened(n, self.capacity - a - b)
        if a == b:
            self._put(a, 2 * n, first, 2, 0)
        else:
            self._put(a, n, first, 1, 0)
            self._put(b, n, first, 1, a)

    def _large(self) -> None:
        c, least = self.capacity, self.capacity // 3 + 1
        partners: list[int] = []
        for a in range(c, c // 2, -1):
            if least <= c - a <= c // 2 and self.left[c - a]:
                partners.append(c - a)
            while self.left[a] and partners:
                b = partners[-1]
                self._pair(a, b, min(self.left[a], self.left[b]))
                if not self.left[b]:
                    partners.pop()
            if self.left[a]:
                self._put(a, n := self.left[a], self._opened(n, c - a), 1, 0)
        single = 0
        for b in range(c // 2, least - 1, -1):
            if single and self.left[b]:
                self._pair(single, b, 1)
                single = 0
            if self.left[b] > 1:
                self._pair(b, b, self.left[b] // 2)
            if self.left[b]:
                single = b
        if single:
            self._put(single, 1, self._opened(1, c - single), 1, 0)

    def _small(self, length: int) -> None:
        gap = length
        while self.left[length]:
            while gap <= self.capacity and not self.gaps[gap]:
                gap += 1
            if gap > self.capacity:
                # As many new sequences as the rest takes; they are the only ones with room for it.
                gap = self.capacity
                self._opened(-(-self.left[length] // (gap // length)), gap)
            first, n = self.gaps[gap].pop()
            k = gap // length
            full = min(n, self.left[length] // k)
            if full:
                self._put(length, full * k, first, k, self.capacity - gap)
                self.gaps[gap - k * length].append((first, full))
            if full < n:
                rest = self.left[length]
                if rest:
                    self._put(length, rest, first + full, rest, self.capacity - gap)
                    self.gaps[gap - rest * length].append((first + full, 1))
                if n - full - bool(rest):
                    self.gaps[gap].append((first + full + bool(rest), n - full - bool(rest)))

    def places(self) -> dict[int, np.ndarray]:
        """The runs of each length as columns, in order of their first ranks."""
        return {length: np.array(runs, np.int64).T for length, runs in self.runs.items()}


def placed(places: dict[int, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of each piece."""
    sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    order = np.argsort(length, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
        size = int(length[mine[0]])
        ranks, _, first, k, at = places[size]
        run = np.searchsorted(ranks, rank[mine], "right") - 1
        i = rank[mine] - ranks[run]
        sequence[mine], offset[mine] = first[run] + i // k[run], at[run] + i % k[run] * size
    return sequence, offset


def _pieces(docs: DataFrame, file: str, fast: str | None, capacity: int, with_ids: bool) -> DataFrame:
    """A row for each piece, with its task and its place among the task's pieces of its length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    kinds = {"piece": "int", "length": "int", "part": "int", "ids": "array<int>"}
    arrow = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, seen = tokens(file, fast), TaskContext.get().partitionId(), Counter()
        for b, texts in slices(batches, 1):
            rows: list[tuple] = []
            for doc_id, raw in zip(b.column(0).to_pylist(), texts, strict=True):
                ids = np.append(t.ids(raw), np.uint32(END)).astype("<u4")
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    mine = ids[start : start + length]
                    rows.append((doc_id, i, start, length, zlib.crc32(mine.tobytes()), part, seen[length]) + (mine.view(np.int32),) * with_ids)
                    seen[length] += 1
            columns = zip(names, zip(*rows, strict=True), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[kinds.get(n, "long")]) for n, c in columns], names)

    return docs.selectExpr("doc_id", "cast(text as binary) text").mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))


def pack_whole(docs: DataFrame, file: str = "byte_bpe_50k.json", fast: str | None = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with `with_ids`, ids."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    pieces = stored(_pieces(docs, file, fast, capacity, with_ids))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).checkpoint()
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    raw = pickle.dumps(plan.places())
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).checkpoint()
    ranked = pieces.join(bounded(before), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = pickle.loads(raw)
        for b in batches:
            sequence, offset = placed(places, b.column("length").to_numpy(), b.column("rank").to_numpy())
            made = {"sequence_id": pa.array(sequence), "offset": pa.array(offset), "start": b.column("start"), "length": b.column("length").cast(pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else b.column(n) for n in names], names)

    schema = ", ".join(f"{n} {'int' if n == 'piece' else 'array<int>' if n == 'ids' else 'long'}" for n in names)
    return ranked.mapInArrow(place, schema)
