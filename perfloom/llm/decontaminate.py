"""Benchmark decontamination by CGK embedding, bit-sampling LSH and edit distance.

Items and documents are sequences of words: runs of letters, digits and bytes from 128 on, with A-Z in lower case; in
scripts that are written without spaces every character is a word. An item of W words is found where a window of the
text is at most `floor(edits * W)` word edits from it.

The CGK embedding walks along a sequence and writes the present word at every step, moving on if a random bit that
belongs to (step, word) is set: sequences a few edits apart become, mostly, equal again after each edit, so their edit
distance turns into a Hamming distance. `SAMPLES` keys of `SAMPLED` written words each are taken from each of `WALKS`
embeddings of every window of an item's size, and looked up among the keys of the items of that size. The words that
edits may push over a window's end are not sampled. Windows that share a key with an item are verified by their edit
distance to it. The numbers are such that, of items edited up to the limit, at least `RECALL` are found, be the edits
changes, insertions or deletions (tests/llm measure it against brute force).

Windows that cannot be near any item are not embedded: d edits leave at least W - 2 - 3d of an item's word triples
in place, which is a bound without loss. Items of one or two words are looked up as they are.

Items are taken in blocks of at most `ITEM_BLOCK` items and about `ITEM_BYTES`, each a pass over the documents; with
several blocks, each pass is written out before the next block reaches the driver. A task holds one block, the words of
one text and at most `WINDOWS` windows. Items of the same words are searched for once, whatever their number.

null items and items without words are not looked for. null and empty texts match nothing. Of repeated rows each gives
its findings; rows with a null doc_id give findings with a null doc_id. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.llm.shingles import mix, words
from perfloom.llm.tables import bounded, checkpoints, slices, small_batches, stored

EDITS, RECALL, WALKS, SAMPLES, SAMPLED = 0.15, 0.95, 16, 6, 3
ITEM_BLOCK, ITEM_BYTES, WINDOWS, PAIRS = 20_000, 16 << 20, 16_384, 1 << 20
_U = np.uint64
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MASK = (1 << 24) - 1
#: UTF-8 of characters of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1(?:[\x80-\x82]|[\x9e-\x9f])[\x80-\xbf]|[\xe3-\xe9][\x80-\xbf]{2}|\xf0[\xa0-\xb3][\x80-\xbf]{2}")


def sequences(texts: list[bytes]) -> list[np.ndarray]:
    """The hashed words of each text."""
    plain = [t.translate(_PLAIN) for t in texts]
    plain = [t if t.isascii() else _UNSPACED.sub(rb" \g<0> ", t) for t in plain]
    hashes, counts = words(plain)
    return np.split(hashes, np.cumsum(counts)[:-1])


def runs(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, n up to 3."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    factors = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    return mix(sum(w[k : k + m] * _U(factors[k]) for k in range(n)) + _U(3 - n))


def embed(windows: np.ndarray, seed: int, steps: np.ndarray) -> dict[int, np.ndarray]:
    """What the CGK embedding of each row writes at some steps."""
    n, size = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), _U)], axis=1).ravel()
    rows, last = np.arange(n) * (size + 1), np.arange(n) * (size + 1) + size
    at, wanted, out = rows.copy(), set(steps.tolist()), {}
    for step in range(int(steps.max()) + 1):
        x = padded[at]
        if step in wanted:
            out[step] = x
        bit = mix(x + _U((seed << 40) + step + 1)) >> _U(63)
        at = np.minimum(at + bit.astype(np.int64), last)
    return out


def lsh_keys(windows: np.ndarray, spare: int) -> np.ndarray:
    """WALKS * SAMPLES keys for each row, of which the last `spare` words are left out as far as they can be."""
    size = windows.shape[1]
    out = []
    for walk in range(WALKS):
        rng = np.random.default_rng([size, walk])
        # A walk takes two steps a word on average.
        places = rng.integers(0, max(1, 2 * (size - spare)), (SAMPLES, SAMPLED))
        e = embed(windows, walk, np.unique(places))
        for at in places:
            key = np.full(len(windows), len(out), _U)
            for k in at.tolist():
                key = mix(key + e[k])
            out.append(key)
    return np.column_stack(out)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a and of b, which are `most` words longer: (distance, length) of the beginning of b's row that is nearest to a's.

    Distances over `most` stand for any larger ones. The band of the matrix that can matter is filled for all rows at once.
    """
    n, size = a.shape
    width = 2 * most + 1
    far = most + 1
    # Column c of row i stands for the first i + c - most words of b.
    row = np.full((width + 2, n), far, np.int16)
    for c in range(most, width):
        row[c + 1] = c - most
    for i in range(1, size + 1):
        new = np.full_like(row, far)
        word = a[:, i - 1]
        for c in range(width):
            j = i + c - most
            if j < 0:
                continue
            best = row[c + 2] + 1
            if j:
                best = np.minimum(best, row[c + 1] + (word != b[:, j - 1]))
                best = np.minimum(best, new[c] + 1)
            new[c + 1] = np.minimum(best, far)
        row = new
    inner = row[1:-1]
    at = inner.argmin(0)
    return inner[at, np.arange(n)].astype(np.int64), size + at - most


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, bytes]], edits: float = EDITS):
        self.edits = edits
        # Items of the same words are one class, searched for once; each of its items is found where the class is.
        by_size: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = {}
        for (i, _), w in zip(rows, sequences([t for _, t in rows]) if rows else (), strict=True):
            if len(w):
                by_size.setdefault(len(w), {}).setdefault(w.tobytes(), (w, []))[1].append(i)
        self.short = {size: list(by_size.pop(size).values()) for size in (1, 2) if size in by_size}
        self.ids = {size: [ids for _, ids in items.values()] for size, items in by_size.items()}
        self.words = {size: np.stack([w for w, _ in items.values()]) for size, items in by_size.items()}
        # Of each triple of an item, the sizes of the items that have it: sorted pairs.
        hashes = [np.unique(np.concatenate([runs(w, 3) for w in held])) for held in self.words.values()]
        sizes = np.repeat(np.array(list(self.words), np.int64), [len(h) for h in hashes])
        flat = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        order = np.argsort(flat, kind="stable")
        self.triples, self.sizes = flat[order], sizes[order]
        self.bits = np.zeros(_MASK + 1, bool)
        self.bits[(self.triples & _U(_MASK)).astype(np.int64)] = True
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, held in self.words.items():
            k = np.concatenate([lsh_keys(held[s : s + self._rows(size)], self.most(size)) for s in range(0, len(held), self._rows(size))])
            order = np.argsort(k.ravel(), kind="stable")
            self.keys[size] = k.ravel()[order], np.repeat(np.arange(len(held)), k.shape[1])[order]
        self.least = min((self.left(s) for s in self.words), default=0)

    def most(self, size: int) -> int:
        return int(self.edits * size)

    def left(self, size: int) -> int:
        """The fewest of an item's triples that its edits can leave."""
        return max(1, size - 2 - 3 * self.most(size))

    @staticmethod
    def _rows(size: int) -> int:
        """Rows that are embedded together, so that these stay within some tens of MB."""
        return max(1, min(4096, (1 << 19) // size))

    def windows(self, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words of the item, first words, windows) of the windows of a document that can be near an item.

        A window goes on behind the item's size by as many words as edits may insert; behind the text's end are zeros.
        """
        t = runs(w, 3)
        hit = np.flatnonzero(self.bits[(t & _U(_MASK)).astype(np.int64)])
        if len(hit) < max(1, self.least):
            return
        lo, hi = np.searchsorted(self.triples, t[hit], "left"), np.searchsorted(self.triples, t[hit], "right")
        count = hi - lo
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        place, of = np.repeat(hit, count), self.sizes[which]
        kinds, numbers = np.unique(of, return_counts=True)
        for size, number in zip(kinds.tolist(), numbers.tolist(), strict=True):
            most, need = self.most(size), self.left(size)
            starts = len(w) - (size - most) + 1
            if number < need or starts <= 0:
                continue
            reach = size + most
            there = np.zeros(len(t) + 1, np.int64)
            there[place[of == size] + 1] = 1
            upto = np.cumsum(there)
            first = np.arange(starts)
            first = first[upto[np.minimum(first + reach - 2, len(t))] - upto[np.minimum(first, len(t))] >= need]
            step = self._rows(size)
            for k in range(0, len(first), step):
                at = first[k : k + step]
                cell = at[:, None] + np.arange(reach)
                yield size, at, np.where(cell < len(w), w[np.minimum(cell, len(w) - 1)], _U(0))

    def near(self, size: int, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Arrays (row, item, edits, words) of windows of one size that share a key with an item and are near it."""
        most = self.most(size)
        sorted_keys, owner = self.keys[size]
        keys = lsh_keys(windows[:, :size], most)
        lo, hi = np.searchsorted(sorted_keys, keys.ravel(), "left"), np.searchsorted(sorted_keys, keys.ravel(), "right")
        n, hits = len(self.words[size]), np.flatnonzero(hi > lo)
        count = (hi - lo)[hits]
        # Windows are taken together as far as their pairs stay within some MB.
        cuts = np.searchsorted(np.cumsum(count), np.arange(PAIRS, int(count.sum()), PAIRS))
        parts = [np.zeros(0, np.int64)]
        for some, many in zip(np.split(hits, cuts), np.split(count, cuts), strict=True):
            which = np.repeat(lo[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
            parts.append(np.unique(owner[which] + np.repeat(some // keys.shape[1] * n, many)))
        code = np.unique(np.concatenate(parts))
        out = []
        for s in range(0, len(code), 4096):
            r, o = np.divmod(code[s : s + 4096], n)
            d, length = edit_distances(self.words[size][o], windows[r], most)
            ok = d <= most
            out.append((r[ok], o[ok], d[ok], length[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4

    def _exact(self, w: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, first word, words, 0) of the items of one and two words."""
        for size, items in self.short.items():
            seen, first = np.unique(runs(w, size), return_index=True)
            for x, ids in items:
                k = int(np.searchsorted(seen, h := runs(x, size)[0]))
                if k < len(seen) and seen[k] == h:
                    yield from ((i, int(first[k]), size, 0) for i in ids)

    def find(self, documents: Iterator[tuple[object, np.ndarray]]) -> Iterator[tuple[object, int, int, int, int]]:
        """(document, item_id, first word, words, edits): for each item found in a document, its nearest window, the first one of several.

        Windows of many documents are embedded together; at most `WINDOWS` wait.
        """
        waiting: dict[int, list] = {}
        best: dict[tuple[int, int, int], tuple] = {}
        n = 0

        def flush() -> None:
            for size, parts in sorted(waiting.items()):
                numbers = np.concatenate([np.full(len(at), number) for number, _, at, _ in parts])
                names = {number: name for number, name, _, _ in parts}
                firsts, rows = np.concatenate([at for _, _, at, _ in parts]), np.concatenate([x for _, _, _, x in parts])
                step = self._rows(size)
                for k in range(0, len(rows), step):
                    for r, o, d, length in zip(*(x.tolist() for x in self.near(size, rows[k : k + step])), strict=True):
                        number, start = int(numbers[k + r]), int(firsts[k + r])
                        old = best.get((number, size, o))
                        if old is None or (d, start) < (old[3], old[1]):
                            best[number, size, o] = (names[number], start, length, d)
            waiting.clear()

        def found_items() -> Iterator[tuple[object, int, int, int, int]]:
            for (_, size, o), (name, start, length, d) in best.items():
                yield from ((name, i, start, length, d) for i in self.ids[size][o])
            best.clear()

        for number, (name, w) in enumerate(documents):
            for found in self._exact(w):
                yield name, *found
            split = False
            for size, at, rows in self.windows(w):
                waiting.setdefault(size, []).append((number, name, at, rows))
                n += len(at)
                if n >= WINDOWS:
                    flush()
                    n, split = 0, True
            if split or n >= WINDOWS // 2:
                flush()
                n = 0
                yield from found_items()
        flush()
        yield from found_items()


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, item_block: int = ITEM_BLOCK, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """A row for each document (doc_id, text) and item (item_id, text) found in it: doc_id, item_id, start_word, n_words, n_edits.

    Documents are not shuffled.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // item_block), -(-size["bytes"] // item_bytes))
    out = None
    for k in range(blocks):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        held = sorted(((r["item_id"], bytes(r["text"])) for r in rows.collect()), key=lambda r: (r[0] is None, r))
        part = docs.selectExpr("doc_id", "cast(text as binary) text").mapInArrow(_search(held, edits), "doc_id long, item_id long, start_word long, n_words long, n_edits long")
        if blocks > 1:
            part = stored(part)
        out = part if out is None else out.unionAll(part)
    return out


def _search(rows: list, edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Items(rows, edits)
        documents = (x for batch, texts in slices(batches, 1) for x in zip(batch.column(0).to_pylist(), sequences(texts), strict=True))
        hits: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*hits, strict=True)) or [()] * 5
            hits.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start_word", "n_words", "n_edits"])

        for hit in found.find(documents):
            hits.append(hit)
            if len(hits) >= 10_000:
                yield batch()
        yield batch()

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the rows in which an item is found. Rows with a null doc_id stay, and rows that repeat a doc_id go if one of them does."""
    checkpoints(docs.sparkSession)
    found = leaks(docs, benchmark, **options).select("doc_id").distinct().checkpoint()
    return docs.join(bounded(found), "doc_id", "left_anti")
