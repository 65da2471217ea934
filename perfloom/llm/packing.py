"""Harmonic packing of documents into sequences of a fixed length.

Lengths fall into classes by the reciprocal of the capacity they take: class k holds lengths in (C/(k+1), C/k], and a
bin of class k is closed when it has k pieces. Every task fills the bins of its own rows; nothing is shuffled.

Documents may be cut. A document gives as many pieces of C tokens as it fills (class 1), then pieces of C/2, C/4, ...
down to `LEAST` tokens for the set bits of the rest (classes 2, 4, ..., which fill their bins without a gap), then one
piece below `LEAST` tokens, in a class of at least C/LEAST pieces. Padding thus stays below LEAST tokens in the bins of
these last pieces, and there is none elsewhere. Bins that are still open at the end of a task are put behind one another
and cut at every C tokens; the end of that is cut into powers of two, which need no padding.

null and empty texts are documents of one token, the end token. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from perfloom.llm.tables import slices, small_batches

CAPACITY = 2048
LEAST = 64
END = 1
#: Texts of other characters, or with long white space, go to the slower library. In these, both give the same ids.
_PLAIN = re.compile(rb"[^\t\n\r\x20-\x7e\xc3-\xc5\x80-\xbf]|[\t\n\r ]{500}")


class Tokens:
    """Token ids as `tokenizers` gives them for a byte-level BPE file. `fast` is a file of the same vocabulary as ranks."""

    def __init__(self, file: str = "byte_bpe_50k.json", fast: str | None = "byte_bpe_50k.tiktoken"):
        import public_tokenizers as P
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(P.path(file))
        self.fast = None
        if fast:
            import tiktoken

            with open(P.path(fast), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, raw: bytes) -> np.ndarray:
        text = raw.decode()
        if self.fast is not None and not _PLAIN.search(raw):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


_tokens: dict[tuple, Tokens] = {}


def tokens(file: str, fast: str | None) -> Tokens:
    if (file, fast) not in _tokens:
        _tokens[file, fast] = Tokens(file, fast)
    return _tokens[file, fast]


def cut(n: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """The lengths of a document's pieces."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= least:
        if rest & size:
            out.append(size)
        size //= 2
    if rest % least:
        out.append(rest % least)
    return out


class Packer:
    """One task's bins. A piece is (doc_id, start, ids, doc_tokens); put() and close() give finished bins."""

    def __init__(self, capacity: int = CAPACITY, least: int = LEAST):
        self.capacity, self.least = capacity, least
        self.open: dict[int, list] = {}

    def put(self, doc_id, ids: np.ndarray) -> Iterator[list]:
        start = 0
        for size in cut(len(ids), self.capacity, self.least):
            piece = (doc_id, start, ids[start : start + size], len(ids))
            start += size
            k = self.capacity // size
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                yield self.open.pop(k)

    def close(self) -> Iterator[list]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        room = [self.capacity] * (total // self.capacity)
        room += [1 << b for b in reversed(range(self.capacity.bit_length() - 1)) if total % self.capacity >> b & 1]
        bins: list[list] = []
        free = 0
        for doc_id, start, ids, n in left:
            at = 0
            while at < len(ids):
                if not free:
                    free = room[len(bins)]
                    bins.append([])
                take = min(free, len(ids) - at)
                bins[-1].append((doc_id, start + at, ids[at : at + take], n))
                at, free = at + take, free - take
        yield from bins


def pack(docs: DataFrame, file: str = "byte_bpe_50k.json", fast: str | None = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, least: int = LEAST, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with `with_ids`, ids.

    Sequences are numbered within a task, whose number is in the upper bits: a task that runs again gives the same.
    """
    if capacity & (capacity - 1) or least & (least - 1):
        raise ValueError("capacity and least must be powers of two")
    small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, packer = tokens(file, fast), Packer(capacity, least)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def add(bin_: list) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, n in bin_:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset) + (ids.view(np.int32),) * with_ids)
                offset += len(ids)
            sequence += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if name == "ids" else pa.int64()) for name, c in zip(names, columns, strict=True)], names)

        for b, texts in slices(batches, 1):
            for doc_id, raw in zip(b.column(0).to_pylist(), texts, strict=True):
                ids = np.append(t.ids(raw), np.uint32(END)).astype("<u4")
                for bin_ in packer.put(doc_id, ids):
                    add(bin_)
                if len(rows) >= 4_000:
                    yield batch()
        for bin_ in packer.close():
            add(bin_)
        yield batch()

    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return docs.selectExpr("doc_id", "cast(text as binary) text").mapInArrow(run, schema)
