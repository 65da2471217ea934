"""Phrases whose words stand together more often than their parts would, counted by suffix arrays over word ids.

A task gathers texts into shards of at most `SHARD_WORDS` words. Words become ids, separators the id 0, and prefix doubling
sorts a shard's suffixes by their first words: ranks by one word give those by two, and these those by four, with one numpy
sort each. Where neighbours in this order share d words they are in one LCP interval of depth d; its size is the count of
that phrase of d words. Shards send (lang, phrase, count), one row for each different phrase, and the counts are summed by
key, so no phrase, however common, meets in one task.

Single words and pairs are counted first. A longer phrase is as rare as its rarest part, so for each further length the
shards send only phrases whose parts, one word shorter, may be frequent: these are marked in a Bloom filter of at most
`FILTER_BYTES`. It lets all frequent phrases through, and more of the others the fuller it is; the result is the same.

A text whose shard is full goes on in the next shard, which starts with the last words of the one before, so no phrase is
lost and none counts twice. null and empty texts have no words; a null lang is `und`; repeated rows count as often as they
occur; ids and other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.llm.tables import bounded, checkpoints, slices, small_batches

SHARD_WORDS, FILTER_BYTES, LEAST, LONGEST, COVERED, TOP = 1_500_000, 16 << 20, 10, 3, 50, 2_000
#: Rows of an Arrow batch that a shard sends.
SENT_ROWS = 65_536
#: Bits that a key sets in the filter.
PROBES = 3
#: Parts of a language of which each finds its own first phrases.
PARTS = 32
#: Lower case for A-Z, a space for a tab, a full stop for every character that ends a piece.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz ..........")
_STOP = b"."


def tokens(raw: bytes, limit: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, with a full stop at each end of a piece, in lists of some `limit` bytes."""
    text = raw.translate(_FOLD).replace(_STOP, b" . ")
    at = 0
    while at < len(text):
        end = text.find(b" ", at + limit)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Ids(dict):
    """Ids of words, given as they come; 0 is the full stop."""

    def __init__(self):
        self[_STOP] = 0

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def suffix_order(w: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of the ids w, sorted by their first `depth` ids or more; ids are below len(w) + 2 or any small number."""
    rank, h, n = w.astype(np.int32), 1, len(w)
    order = np.argsort(rank, kind="stable")
    while h < depth:
        key = rank.astype(np.int64)
        key *= int(rank.max(initial=0)) + 1
        key[: max(0, n - h)] += rank[h:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        # From 1, as 0 stands for what is behind the end.
        rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1])[:n], dtype=np.int32)
        h *= 2
    return order


def phrase_counts(w: np.ndarray, sizes: list[int], counted: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """size: (a start in w, count) of each different phrase without a 0. Only starts below `counted` count."""
    longest = max(sizes)
    order = suffix_order(w, longest)
    if counted is not None:
        order = order[order < counted]
    padded = np.append(w, np.zeros(longest, w.dtype))
    same, whole = np.ones(max(0, len(order) - 1), bool), np.ones(len(order), bool)
    out = {}
    for d in range(1, longest + 1):
        word = padded[order + (d - 1)]
        same &= word[1:] == word[:-1]
        whole &= word != 0
        if d in sizes:
            first = np.flatnonzero(np.append(True, ~same)[: len(order)])
            count = np.diff(np.append(first, len(order)))
            keep = whole[first]
            out[d] = order[first[keep]], count[keep]
    return out


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words), np.uint64, len(words))


def phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase from the hashes of its words."""
    h = np.zeros_like(columns[0])
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The bits of a filter of `size` bits, a power of two, that stand for each hash."""
    mask = np.uint64(size - 1)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + step * np.uint64(i)) & mask).astype(np.int64) for i in range(PROBES)]


class Shard:
    """The words of one task's texts so far, by language."""

    def __init__(self, sizes: list[int], known: np.ndarray | None = None):
        self.sizes, self.known = sizes, known
        self._new()

    def _new(self) -> None:
        self.ids, self.parts, self.size = _Ids(), {}, 0

    def add(self, lang: str, words: list[bytes]) -> None:
        self.parts.setdefault(lang, []).append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def close(self, open_lang: str | None = None) -> Iterator[pa.RecordBatch]:
        """Sends the counts. If a text of `open_lang` goes on, its last words stay for the next shard."""
        words = list(self.ids)
        known = None if self.known is None else hashes(words)
        vocabulary = pa.array(words, pa.binary())
        carried: list[bytes] = []
        for lang, parts in self.parts.items():
            w = np.concatenate(parts)
            counted = len(w)
            if lang == open_lang:
                tail = w[max(0, len(w) - max(self.sizes) + 1) :]
                tail = tail[len(tail) - int(np.argmax(tail[::-1] == 0)) :] if (tail == 0).any() else tail
                counted, carried = len(w) - len(tail), [words[i] for i in tail.tolist()]
            if 1 in self.sizes:
                yield _rows(lang, 0, pa.array([b""], pa.binary()), np.array([np.count_nonzero(w[:counted])]))
            for d, (start, count) in phrase_counts(w, self.sizes, counted).items():
                at = [w[start + j] for j in range(d)]
                if known is not None:
                    keep = np.ones(len(start), bool)
                    for part in (at[:-1], at[1:]):
                        for b in bits(phrase_hash([known[c] for c in part]), len(self.known) * 8):
                            keep &= (self.known[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)
                    at, count = [c[keep] for c in at], count[keep]
                for s in range(0, len(count), SENT_ROWS):
                    columns = [vocabulary.take(pa.array(c[s : s + SENT_ROWS])) for c in at]
                    phrase = columns[0] if d == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()))
                    yield _rows(lang, d, phrase, count[s : s + SENT_ROWS])
        self._new()
        if carried:
            self.add(open_lang, carried)


def _rows(lang: str, size: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    n = len(count)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), phrase, pa.array(count.astype(np.int64))], ["lang", "size", "phrase", "n"])


def counts(docs: DataFrame, sizes: list[int], known: np.ndarray | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, size, phrase, n: how often each phrase of these sizes stands in the texts; size 0 has the number of words.

    `known` is a Bloom filter; with it only phrases both of whose parts, one word shorter, are in it need be counted.
    """
    raw = None if known is None else pickle.dumps(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(sizes, None if raw is None else pickle.loads(raw))
        for batch, texts in slices(batches, 1):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                for words in tokens(_STOP.join(some)):
                    shard.add(lang, words)
                    if shard.size >= shard_words:
                        yield from shard.close(lang)
                shard.add(lang, [_STOP])
        yield from shard.close()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    sent = rows.mapInArrow(run, "lang string, size int, phrase binary, n long")
    return sent.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))


def bloom(phrases: DataFrame, limit: int = FILTER_BYTES) -> np.ndarray:
    """A filter of the column `phrase`, with 16 bits a phrase or more as far as `limit` bytes reach."""
    n = phrases.count()
    size = 1 << int(min(limit * 8, max(64, 16 * n))).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [p.split(b" ") for p in b.column(0).to_pylist()]
            columns = [hashes(list(c)) for c in zip(*parts, strict=True)]
            h = np.unique(np.concatenate(bits(phrase_hash(columns), size))) if columns else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h >> 6), pa.array(np.left_shift(np.int64(1), h & 63))], ["at", "bit"])

    filled = phrases.select(F.col("phrase").cast("binary")).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(max(1, size // 64), "<i8")
    out[filled.column("at").to_numpy()] = filled.column("bit").to_numpy()
    return out.view(np.uint8)


def _between(words: str, start: str, length: str) -> Column:
    return F.expr(f"array_join(slice({words}, {start}, {length}), ' ')")


def _first(rows: DataFrame, by: list, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to `longest` words that stand `least` times or more.

    A phrase cut into two parts has the score floor(10^6 a^2 / (l r)) of its own count a and its parts' l and r, and the
    lowest of its cuts counts. Phrases that lie in a longer one with at least `covered` percent of their count are left
    out. Products are decimals of 38 digits: exact for counts up to 10^15.
    """
    if longest < 2:
        raise ValueError("phrases have at least two words")
    checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    found = counts(docs, [1, 2], None, shard_words).where((F.col("n") >= least) | (F.col("size") == 0)).checkpoint()
    total = found.where("size = 0").select("lang", F.col("n").alias("total"))
    frequent = found.where("size > 0")
    for d in range(3, longest + 1):
        more = counts(docs, [d], bloom(frequent.where(F.col("size") == d - 1)), shard_words).where(F.col("n") >= least).checkpoint()
        frequent = frequent.unionByName(more)
    phrases = frequent.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("w"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _between("w", "1", "k").alias("left"), _between("w", "k + 1", "size - k").alias("right"))
    part = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    parts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    scored = parts.select("*", (wide["a"] * wide["a"]).alias("over"), (wide["l"] * wide["r"]).alias("under")).withColumn("score", F.expr("(over * 1000000) div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("s")).select("lang", "phrase", "s.score", "s.l", "s.r", "s.a")
    if longest > 2:
        inner = phrases.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
        inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
        longer = inner.select("lang", _between("w", "i", "m").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        best = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True))).drop("longer")
    # A language's first phrases are among the first of its parts.
    some = _first(best.withColumn("p", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), ["lang", "p"], top).drop("p", "rank")
    return _first(some, ["lang"], top).join(bounded(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
