"""Exact substring dedup: every byte goes that is covered by a string of `length` bytes that also starts anywhere else.

1. Anchors. Each window of `length` bytes has one anchor, the place in it with the smallest hash of `ANCHOR` bytes; it
   follows from the window's content alone. Equal windows thus have equal anchors at equal offsets, and a window can
   only repeat among the occurrences of its anchor. An occurrence with the windows it belongs to is a context: about
   1.4 % of all places, each some 270 bytes long.
2. Anchors that occur once are dropped; equal contexts are counted, and all their windows repeat.
3. Anchors with contexts that differ are resolved by suffix arrays: a task puts the bytes from the anchors on, and in a
   second text those from the anchors back, into blocks of eight bytes, sorts the suffixes by linear grouping, and has
   from neighbours how far any two contexts agree in both directions. A window repeats if another context agrees with
   it as far as its two ends. Anchors with over `CONTEXTS` different contexts go a way of their own, which counts each
   of their windows by its hash across the cluster.
4. The windows' spans are joined by text, and equal texts share them.

Strings are judged on the input. null and empty texts, and those under `length` bytes, lose nothing. Repeated rows are
copies of each other. Texts are told apart by two 64-bit hashes. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from perfloom.llm import shingles
from perfloom.llm.gsaca import suffix_array
from perfloom.llm.tables import bounded, brief_shuffles, checkpoints, dropped, slices, small_batches, spread_join, stored

LENGTH, ANCHOR, CONTEXTS, BATCH, PAIRED = 200, 64, 20_000, 4_000, 12
_U = np.uint64
_CHUNK = 900_000
_PLACE = _U((1 << 20) - 1)
_IDENTITY = ("xxhash64(cast(text as binary)) u1", "xxhash64(7, cast(text as binary)) u2")


class Hashed:
    """Hashes of any stretch of some bytes."""

    def __init__(self, text: np.ndarray):
        power, self.inverse = shingles._tables(len(text) + 1)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(shingles._BYTE[text] * power[: len(text)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return shingles.mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % width, ~_U(0))]).reshape(-1, width)
    forth = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


def contexts(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """The contexts of all windows within the texts: text, p (anchor), first and last window (places in the text), key and c (hashes of anchor and context)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "p", "first", "last", "key", "c")}
    every = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    for at in range(0, max(0, len(every) - length + 1), _CHUNK):
        part = every[at : at + _CHUNK + length - 1]
        h = Hashed(part)
        n = len(part) - anchor + 1
        place = np.arange(n)
        key = h.of(place, place + anchor)
        least = (_least((key & ~_PLACE) | place.astype(_U), length - anchor + 1) & _PLACE).astype(np.int64)
        start = np.arange(len(least)) + at
        owner = np.searchsorted(ends, start, "right")
        ok = start + length <= ends[owner]
        code = np.where(ok, owner, -1)
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (code[1:] != code[:-1])]))
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        good = ok[first]
        first, last = first[good], last[good]
        p, o = least[first], owner[first + 0]
        begin = ends[o] - sizes[o] - at
        c = h.of(first, last + length)
        out["c"].append(shingles.mix(c + (p - first).astype(_U) * _U(0x9E3779B97F4A7C15) + (last - first).astype(_U)))
        for k, v in (("text", o), ("p", p - begin), ("first", first - begin), ("last", last - begin), ("key", key[p])):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _agreement(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the order of `parts`, how many bytes each has in common with the next one in it; zeros stand behind their ends)."""
    wide = max(map(len, parts)) + 7 & ~7
    rows = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), np.uint8).reshape(len(parts), wide)
    blocks = rows.view(">u8")
    _, rank = np.unique(blocks.ravel(), return_inverse=True)
    text = np.ones((len(parts), blocks.shape[1] + 1), np.int64)
    text[:, :-1] = rank.reshape(blocks.shape) + 2
    used = [-(-len(p) // 8) for p in parts]
    keep = np.arange(blocks.shape[1] + 1)[None] <= np.array(used)[:, None]
    keep[:, -1] = False
    text[np.arange(len(parts)), used] = 1
    keep[np.arange(len(parts)), used] = True
    symbols = text[keep].tolist() + [0]
    starts = np.concatenate([[0], np.cumsum(keep.sum(1))[:-1]])
    owner = np.full(len(symbols), -1)
    owner[starts] = np.arange(len(parts))
    order = owner[np.array(suffix_array(symbols))]
    order = order[order >= 0]
    same = rows[order[:-1]] == rows[order[1:]]
    return order, np.where(same.all(1), wide, same.argmin(1)) if len(same) else np.zeros(0, np.int64)


def resolve(keys: np.ndarray, offsets: np.ndarray, windows: np.ndarray, texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> list[np.ndarray]:
    """For each context (key, anchor's offset, number of windows, bytes), which of its windows another context of the key has too."""
    n = len(keys)
    if not n:
        return []
    base = np.concatenate([[0], np.cumsum(windows + 1)])
    # One more where a run of windows begins and one less behind its end, for all contexts in one array.
    change = np.zeros(base[-1] + 1, np.int64)

    def mark(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The windows that begin `low` to `high` bytes before the anchors of contexts i."""
        np.add.at(change, base[i] + offsets[i] - high, 1)
        np.add.at(change, base[i] + offsets[i] - low + 1, -1)

    forth, ahead = _agreement([t[o:] for t, o in zip(texts, offsets.tolist(), strict=True)])
    # Backwards, the anchor itself comes first, so that the contexts of a key are neighbours here too.
    back, behind = _agreement([t[: o + anchor][::-1] for t, o in zip(texts, offsets.tolist(), strict=True)])
    behind = behind - anchor
    place_b = np.argsort(back)
    least_o, most_o = np.maximum(0, offsets - windows + 1), offsets

    def groups(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the run of each key, by key."""
        k = keys[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        by = np.argsort(k[start])
        return start[by], np.diff(np.concatenate([start, [n]]))[by]

    f_start, size = groups(forth)
    b_start, _ = groups(back)
    for m in np.unique(size[size > 1]).tolist():
        of = np.flatnonzero(size == m)
        if m > PAIRED:
            for g in of.tolist():
                f, b = forth[f_start[g] : f_start[g] + m], back[b_start[g] : b_start[g] + m]
                _sweep(f, b, ahead[f_start[g] : f_start[g] + m - 1], behind[b_start[g] : b_start[g] + m - 1], least_o, most_o, length, mark)
            continue
        # All groups of this size at once: every pair agrees as far as the least agreement of the neighbours between.
        members = forth[f_start[of][:, None] + np.arange(m)]
        right, left = ahead[f_start[of][:, None] + np.arange(m - 1)], behind[b_start[of][:, None] + np.arange(m - 1)]
        between = np.full((len(of), m, m), 1 << 30)
        for x in range(m):
            for y in range(x + 1, m):
                between[:, x, y] = np.minimum(between[:, x, y - 1], left[:, y - 1])
        place = place_b[members] - b_start[of][:, None]
        row = np.arange(len(of))
        for x in range(m):
            far = np.full(len(of), 1 << 30)
            for y in range(x + 1, m):
                far = np.minimum(far, right[:, y - 1])
                i, j = members[:, x], members[:, y]
                near = between[row, np.minimum(place[:, x], place[:, y]), np.maximum(place[:, x], place[:, y])]
                # A window that begins o bytes before the anchor needs o bytes on the left and the rest on the right.
                low = np.maximum(np.maximum(length - far, least_o[i]), least_o[j])
                high = np.minimum(np.minimum(near, most_o[i]), most_o[j])
                ok = low <= high
                mark(i[ok], low[ok], high[ok])
                mark(j[ok], low[ok], high[ok])
    covered = np.cumsum(change) > 0
    return [covered[a : a + w] for a, w in zip(base[:-1].tolist(), windows.tolist(), strict=True)]


def _sweep(f: np.ndarray, b: np.ndarray, right: np.ndarray, left: np.ndarray, least_o: np.ndarray, most_o: np.ndarray, length: int, mark) -> None:
    """A large group, in both orders: at each offset, contexts fall into classes by agreement to the right and to the left, and those that share both have a window in common."""
    at = np.argsort(f)
    members = f[at]
    b_at = np.searchsorted(members, b)
    for o in range(int(least_o[members].min()), int(most_o[members].max()) + 1):
        owns = (least_o[members] <= o) & (most_o[members] >= o)
        if owns.sum() < 2:
            continue
        right_class, left_class = np.empty(len(f), np.int64), np.empty(len(f), np.int64)
        right_class[np.searchsorted(members, f)] = np.concatenate([[0], np.cumsum(right < length - o)])
        left_class[b_at] = np.concatenate([[0], np.cumsum(left < o)])
        code = (right_class * (len(f) + 1) + left_class)[owns]
        _, which, count = np.unique(code, return_inverse=True, return_counts=True)
        hit = members[owns][count[which] > 1]
        mark(hit, np.full(len(hit), o), np.full(len(hit), o))


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _anchored(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 2):
            c = contexts(texts, length, anchor)
            who = pa.array(c["text"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(who), batch.column(1).take(who), pa.array(c["key"].astype(_U).view(np.int64)), pa.array(c["c"].astype(_U).view(np.int64)), *(pa.array(c[k].astype(np.int32)) for k in ("p", "first", "last"))],
                ["u1", "u2", "key", "c", "p", "first", "last"],
            )

    rows = docs.where(f"octet_length(text) >= {length}").selectExpr(*_IDENTITY, "cast(text as binary) text")
    return rows.mapInArrow(run, "u1 long, u2 long, key long, c long, p int, first int, last int")


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, c, o (the anchor's offset), w (windows) and the bytes of the contexts `wanted` (key, c, u1, u2, p, first, last)."""
    of = wanted.groupBy("u1", "u2").agg(F.collect_list(F.struct("key", "c", "p", "first", "last")).alias("xs")).checkpoint()
    texts = docs.where(f"octet_length(text) >= {length}").selectExpr(*_IDENTITY, "cast(text as binary) text")
    # Of copies one is enough; only texts with such contexts are shuffled.
    texts = texts.join(bounded(of.select("u1", "u2").checkpoint()), ["u1", "u2"], "left_semi").groupBy("u1", "u2").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 0):
            rows = [(x["key"], x["c"], x["p"] - x["first"], x["last"] - x["first"] + 1, t[x["first"] : x["last"] + length]) for t, xs in zip(raw, batch.column(1).to_pylist(), strict=True) for x in xs]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["key", "c", "o", "w", "bytes"])

    return texts.join(of, ["u1", "u2"]).select("text", "xs").mapInArrow(run, "key long, c long, o int, w int, bytes binary")


_RANGES = "key long, c long, ranges array<struct<a:int,b:int>>"


def _resolved(cut: DataFrame, length: int, anchor: int) -> DataFrame:
    """key, c, ranges: the windows of contexts that other contexts have too, by suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[dict]) -> pa.RecordBatch:
            found = resolve(np.array([r["key"] for r in rows]), np.array([r["o"] for r in rows]), np.array([r["w"] for r in rows]), [r["bytes"] for r in rows], length, anchor)
            hit = [(r["key"], r["c"], [{"a": a, "b": b} for a, b in _runs(m)]) for r, m in zip(rows, found, strict=True) if m.any()]
            columns = list(zip(*hit, strict=True)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["key", "c", "ranges"])

        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= BATCH and r["key"] != held[-1]["key"]:
                    yield done(held)
                    held = []
                held.append(r)
        if held:
            yield done(held)

    return cut.repartition("key").sortWithinPartitions("key").mapInArrow(run, _RANGES)


def _counted(cut: DataFrame, length: int) -> DataFrame:
    """As `_resolved`, for anchors with too many contexts for a task: every window is counted by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 4):
            hashes, at = [], []
            for t, w in zip(raw, batch.column(3).to_pylist(), strict=True):
                h = Hashed(np.frombuffer(t, np.uint8))
                hashes.append(h.of(np.arange(w), np.arange(w) + length))
                at.append(np.arange(w))
            who = pa.array(np.repeat(np.arange(len(raw)), [len(x) for x in at]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], ["key", "c", "i", "h"])

    rows = cut.mapInArrow(run, "key long, c long, i int, h long")
    twice = rows.groupBy("key", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(twice, ["key", "h"]).groupBy("key", "c").agg(F.transform(F.collect_set("i"), lambda i: F.struct(i.alias("a"), i.alias("b"))).alias("ranges"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_contexts: int = CONTEXTS) -> DataFrame:
    """u1, u2 (the text's hashes), spans, n_rows: the disjoint runs of bytes (start, end) that go, in order, and how many rows have the text."""
    checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    anchors = stored(_anchored(docs, length, anchor))
    keys = anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1").selectExpr("key", "n rows", "lo <> hi mixed").checkpoint()
    shared = stored(spread_join(anchors, keys, ["key"], "rows", anchors.count(), grows=True))
    each = shared.groupBy("key", "c", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("u1", "u2", "p", "first", "last")).alias("x")).checkpoint()
    groups = each.where("mixed").groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("size")).where("least = 1 and size > 1").select("key", "size").checkpoint()
    wanted = each.join(bounded(groups), "key").select("key", "c", "size", "x.*")
    cut = _cut_out(docs, wanted, length).join(bounded(groups), "key").checkpoint()
    found = _resolved(cut.where(f"size <= {most_contexts}").drop("size"), length, anchor).unionAll(_counted(cut.where(f"size > {most_contexts}").drop("size"), length))
    whole = "array(struct(0 as a, 2147483647 as b))"
    marks = each.select("key", "c", "n").join(found, ["key", "c"], "left").selectExpr("key", "c", "n", f"case when n > 1 then {whole} else ranges end ranges").where("ranges is not null").checkpoint()
    rows = spread_join(shared.select("key", "c", "u1", "u2", "first", "last"), marks, ["key", "c"], "n", shared.count(), grows=True)
    rows = rows.select("u1", "u2", F.transform("ranges", lambda r: F.struct((F.col("first") + r["a"]).alias("start"), (F.when(r["b"] > F.col("last") - F.col("first"), F.col("last")).otherwise(F.col("first") + r["b"]) + length).alias("end"))).alias("spans")).distinct()
    gathered = rows.groupBy("u1", "u2").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(2):
                v = spans.values
                s, e = v.field("start").to_numpy(), v.field("end").to_numpy()
                o = np.argsort(s, kind="stable")
                s, e = s[o], np.maximum.accumulate(e[o])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                out.append([{"start": int(x), "end": int(y)} for x, y in zip(s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["u1", "u2", "spans"])

    # Every row of `docs` that is long enough has one context that begins with it.
    holders = anchors.where("first = 0").groupBy("u1", "u2").agg(F.count("*").alias("n_rows"))
    out = gathered.mapInArrow(merge, "u1 long, u2 long, spans array<struct<start:int,end:int>>").join(holders, ["u1", "u2"]).checkpoint()
    dropped(anchors)
    dropped(shared)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_contexts: int = CONTEXTS) -> DataFrame:
    """`docs` with the remaining bytes as `kept` (binary) in place of `text`, and n_bytes, n_removed and n_spans."""
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    with brief_shuffles(docs.sparkSession):
        spans = repeated_spans(docs, length, anchor, most_contexts)
    others = [c for c in docs.columns if c != "text"]
    plain = docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(others)], F.col("text").cast("binary").alias("text"), *[F.expr(e) for e in _IDENTITY])
    # Short texts, of which there may be many equal ones, lose nothing and need no join.
    long = F.octet_length("text") >= length
    rows = spread_join(plain.where(long), spans, ["u1", "u2"], "n_rows", docs.count(), "left")
    rows = rows.unionByName(plain.where(F.coalesce(~long, F.lit(True))), allowMissingColumns=True).select(*[f"d{i}" for i in range(len(others))], "text", "spans")
    at = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, at):
            kept, removed, runs = [], [], []
            for t, spans in zip(texts, batch.column(at + 1).to_pylist(), strict=True):
                ends = [0, *(s["end"] for s in spans or ())]
                starts = [*(s["start"] for s in spans or ()), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(ends, starts, strict=True)))
                removed.append(len(t) - len(kept[-1]))
                runs.append(len(starts) - 1)
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(kept, pa.binary()), *(pa.array(v, pa.int64()) for v in (sizes, removed, runs))], [*others, "kept", "n_bytes", "n_removed", "n_spans"])

    fields = [docs.schema[c] for c in others] + [StructField("kept", BinaryType()), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans"))]
    return rows.mapInArrow(run, StructType(fields))
